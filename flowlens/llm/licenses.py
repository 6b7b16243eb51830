"""Licence scan: ordered signature rules over the words of whole texts.

A text is reduced to lower-case words parted by one space, so that a rule is a
regular expression over words.  A rule is tried only where its keyword stands in
the text (one automaton finds the keywords of all rules in one pass).  Each rule
has a priority; detections that overlap are resolved by it, and a detection
inside another one's interval is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import small_batches, with_columns

#: Phrases of consecutive words that are always reported, and their labels (fixed values).
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Bytes under 0x80 other than 0-9 A-Z a-z part words.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_LIC = r"(?:public )?licen[cs]e"
_VER = r"(?: (?:version|v) ?| v| )?"
# Between a short name and its number (GPLv3, GPL-3.0, GPL version 3), and what may follow the number.
_GAP = r"(?: ?v ?| version | )"
_LATER = r"(?: only| or later| or newer| or any later version)?"
_FSF = r"as published by the free software foundation (?:either )?version"

# Hand-written names: label, keyword that must stand in the text, expression over lower-case words.
# The keyword starts a word of whatever the expression matches, in each of its alternatives.
# An expression names a licence by itself; the forms below put it in the frames that notices use.
_NAMES = (
    ("agpl-1.0", "affero", rf"affero general {_LIC}{_VER}1"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general {_LIC}{_VER}3"),
    ("agpl", "affero", rf"(?:gnu )?affero general {_LIC}"),
    ("lgpl-2.0", "lesser", rf"(?:gnu )?lesser general {_LIC}{_VER}2 0"),
    ("lgpl-2.0", "library", rf"(?:gnu )?library general {_LIC}{_VER}2(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general {_LIC}{_VER}2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general {_LIC}{_VER}3"),
    ("lgpl", "lesser", rf"(?:gnu )?lesser general {_LIC}"),
    ("lgpl", "library", rf"(?:gnu )?library general {_LIC}"),
    ("gpl-1.0", "general", rf"(?:gnu )?general {_LIC}{_VER}1"),
    ("gpl-2.0", "general", rf"(?:gnu )?general {_LIC}{_VER}2"),
    ("gpl-3.0", "general", rf"(?:gnu )?general {_LIC}{_VER}3"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e"),
    ("apache-1.0", "apache", rf"apache (?:software )?licen[cs]e{_VER}1 0"),
    ("apache-1.1", "apache", rf"apache (?:software )?licen[cs]e{_VER}1 1"),
    ("apache-2.0", "apache", rf"apache (?:software )?licen[cs]e{_VER}2(?: 0)?"),
    ("apache", "apache", r"apache software licen[cs]e"),
    ("mit", "mit", r"mit (?:x11 )?licen[cs]e|mit style licen[cs]e"),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("x11", "consortium", r"x consortium licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("isc", "modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", "clause", r"zero clause bsd|0 clause bsd|bsd zero clause"),
    ("bsd-2-clause", "clause", r"(?:bsd 2|2|two) clause(?: bsd)?(?: licen[cs]e)?"),
    ("bsd-3-clause", "clause", r"(?:bsd 3|3|three) clause(?: bsd)?(?: licen[cs]e)?"),
    ("bsd-4-clause", "clause", r"(?:bsd 4|4|four) clause(?: bsd)?(?: licen[cs]e)?"),
    ("bsd-4-clause", "original", r"original bsd licen[cs]e"),
    ("bsd-2-clause", "simplified", r"simplified bsd licen[cs]e"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("mpl-1.0", "mozilla", rf"mozilla {_LIC}{_VER}1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla {_LIC}{_VER}1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla {_LIC}{_VER}2(?: 0)?"),
    ("mpl", "mozilla", rf"mozilla {_LIC}"),
    ("epl-1.0", "eclipse", rf"eclipse {_LIC}{_VER}1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse {_LIC}{_VER}2(?: 0)?"),
    ("epl", "eclipse", rf"eclipse {_LIC}"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e"),
    ("cddl-1.0", "distribution", rf"common development and distribution licen[cs]e{_VER}1 0"),
    ("cddl-1.1", "distribution", rf"common development and distribution licen[cs]e{_VER}1 1"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "common", rf"common {_LIC}{_VER}1 0"),
    ("cpl", "common", r"common public licen[cs]e"),
    ("cpal", "attribution", r"common public attribution licen[cs]e"),
    ("ipl", "ibm", r"ibm public licen[cs]e"),
    ("osl-3.0", "open", rf"open software licen[cs]e{_VER}3(?: 0)?"),
    ("osl", "open", r"open software licen[cs]e"),
    ("afl-3.0", "academic", rf"academic free licen[cs]e{_VER}3(?: 0)?"),
    ("afl", "academic", r"academic free licen[cs]e"),
    ("artistic-1.0", "artistic", rf"artistic licen[cs]e{_VER}1(?: 0)?"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{_VER}2(?: 0)?"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e"),
    ("bsl-1.0", "boost", rf"boost software licen[cs]e{_VER}1 0"),
    ("bsl", "boost", r"boost (?:software )?licen[cs]e"),
    ("busl-1.1", "business", r"business source licen[cs]e"),
    ("sspl", "server", rf"server side {_LIC}"),
    ("elastic-2.0", "elastic", rf"elastic licen[cs]e{_VER}2(?: 0)?"),
    ("elastic", "elastic", r"elastic licen[cs]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "want", r"do what the f\w* you want to public licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("php", "php", r"php licen[cs]e(?: version 3 01?)?"),
    ("python", "python", r"python software foundation licen[cs]e"),
    ("python", "psf", r"psf licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("tcl", "tcl", r"tcl tk licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e"),
    ("icu", "icu", r"icu licen[cs]e"),
    ("unicode", "unicode", r"unicode (?:data files and software )?licen[cs]e(?: agreement)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e"),
    ("ntp", "ntp", r"ntp licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("qpl", "public", r"q public licen[cs]e"),
    ("ms-pl", "microsoft", rf"microsoft {_LIC}"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("rpl", "reciprocal", r"reciprocal public licen[cs]e"),
    ("npl", "netscape", r"netscape public licen[cs]e"),
    ("apsl", "apple", r"apple public source licen[cs]e"),
    ("sissl", "sun", r"sun industry standards source licen[cs]e"),
    ("spl", "sun", r"sun public licen[cs]e"),
    ("eupl-1.2", "european", rf"european union {_LIC}{_VER}1 2"),
    ("eupl", "european", rf"european union {_LIC}"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: free software)? licen[cs]e"),
    ("mulan", "mulan", r"mulan permissive software licen[cs]e"),
    ("upl", "universal", r"universal permissive licen[cs]e"),
    ("ofl-1.1", "open", r"sil open font licen[cs]e|open font licen[cs]e"),
    ("ufl", "ubuntu", r"ubuntu font licen[cs]e"),
    ("beerware", "beer", r"beer ?ware licen[cs]e"),
    ("blueoak", "oak", r"blue oak model licen[cs]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[cs]e"),
    ("prosperity", "prosperity", r"prosperity public licen[cs]e"),
    ("parity", "parity", r"parity public licen[cs]e"),
    ("opl", "publication", r"open publication licen[cs]e"),
    ("fal", "art", r"free art licen[cs]e|licence art libre"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by", "commons", r"open data commons attribution licen[cs]e"),
    ("pddl", "commons", r"open data commons public domain dedication(?: and licen[cs]e)?"),
    ("ogl", "government", r"open government licen[cs]e"),
    ("cdla-permissive", "community", r"community data licen[cs]e agreement permissive"),
    ("cdla-sharing", "community", r"community data licen[cs]e agreement sharing"),
    ("rail", "creativeml", r"creativeml (?:open )?(?:rail|licen[cs]e)(?: [ms])?"),
    ("rail", "bigscience", r"bigscience (?:open )?(?:rail|licen[cs]e)(?: [ms])?"),
    ("rail", "responsible", r"responsible ai (?:open )?(?:rail|licen[cs]e)(?: [ms])?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "commons", r"creative commons (?:cc0|zero)"),
    ("cc-by", "commons", r"creative commons attribution(?: licen[cs]e)?(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero"),
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("gpl", "gnu", r"gnu org licenses gpl"),
    ("lgpl", "gnu", r"gnu org licenses lgpl"),
    ("agpl", "gnu", r"gnu org licenses agpl"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[cs]e)"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    # short forms
    ("gpl-1.0", "gpl", rf"(?:gnu )?gpl{_GAP}1(?: 0)?{_LATER}"),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{_GAP}2(?: 0)?{_LATER}"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{_GAP}3(?: 0)?{_LATER}"),
    ("gpl", "gpl", r"gnu gpl|gpl licen[cs]ed?"),
    ("lgpl-2.0", "lgpl", rf"(?:gnu )?lgpl{_GAP}2(?: 0)?{_LATER}"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl{_GAP}2 1{_LATER}"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl{_GAP}3(?: 0)?{_LATER}"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl-1.0", "agpl", rf"(?:gnu )?agpl{_GAP}1(?: 0)?{_LATER}"),
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl{_GAP}3(?: 0)?{_LATER}"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "gfdl", rf"(?:gnu )?gfdl(?:{_GAP}1 [123])?"),
    ("apache-2.0", "apache", r"apache(?: ?v ?| version )2(?: 0)?|apache 2 licen[cs]ed?"),
    ("apache-2.0", "apache", r"apache 2 0(?! (?:web|http|httpd|server|module|handler) )"),
    ("apache-2.0", "asl", rf"asl{_GAP}2 0"),
    ("apache", "apache", r"apache licen[cs]ed"),
    ("mit", "mit", r"mit licen[cs]ed|mit x11|mit expat"),
    ("mit", "expat", r"expat licen[cs]ed?"),
    ("isc", "isc", r"isc licen[cs]ed"),
    ("bsd", "bsd", r"bsd licen[cs]ed"),
    ("mpl-1.0", "mpl", rf"mpl{_GAP}1 0"),
    ("mpl-1.1", "mpl", rf"mpl{_GAP}1 1"),
    ("mpl-2.0", "mpl", rf"mpl{_GAP}2(?: 0)?"),
    ("mpl", "mpl", r"mpl licen[cs]ed?"),
    ("epl-1.0", "epl", rf"epl{_GAP}1 0"),
    ("epl-2.0", "epl", rf"epl{_GAP}2 0"),
    ("eupl-1.1", "eupl", rf"eupl{_GAP}1 1"),
    ("eupl-1.2", "eupl", rf"eupl{_GAP}1 2"),
    ("eupl", "eupl", r"eupl"),
    ("cddl-1.0", "cddl", rf"cddl{_GAP}1 0"),
    ("cddl-1.1", "cddl", rf"cddl{_GAP}1 1"),
    ("cddl", "cddl", r"cddl"),
    ("bsl-1.0", "bsl", rf"bsl{_GAP}1 0"),
    ("busl-1.1", "bsl", rf"bsl{_GAP}1 1"),
    ("busl-1.1", "busl", rf"busl(?:{_GAP}1 1)?"),
    ("sspl", "sspl", rf"sspl(?:{_GAP}1(?: 0)?)?"),
    ("osl-3.0", "osl", rf"osl{_GAP}3 0"),
    ("afl-3.0", "afl", rf"afl{_GAP}3 0"),
    ("artistic-1.0", "artistic", rf"artistic{_GAP}1 0"),
    ("artistic-2.0", "artistic", rf"artistic{_GAP}2 0"),
    ("wtfpl", "wtfpl", rf"wtfpl(?:{_GAP}2(?: 0)?)?"),
    ("ofl-1.1", "ofl", rf"ofl{_GAP}1 1"),
    ("ofl-1.1", "sil", r"sil ofl"),
    ("odbl", "odbl", rf"odbl(?:{_GAP}1 0)?"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("pddl", "pddl", rf"pddl(?:{_GAP}1 0)?"),
    ("cecill", "cecill", rf"cecill{_GAP}[12](?: [01])?"),
    ("rail", "openrail", r"openrail(?: m)?(?: licen[cs]e)?"),
    ("commons-clause", "commons", r"commons clause(?: licen[cs]e)?(?: condition)?"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("bsl-1.0", "boost", r"boost org license 1 0"),
    ("mit", "opensource", r"opensource org licenses mit"),
    ("bsd", "opensource", r"opensource org licenses bsd"),
    ("apache-2.0", "opensource", r"opensource org licenses apache 2 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    # sentences of the texts themselves
    ("gpl-2.0", "general", rf"general public licen[cs]e {_FSF} 2"),
    ("gpl-3.0", "general", rf"general public licen[cs]e {_FSF} 3"),
    ("lgpl-2.1", "lesser", rf"lesser general public licen[cs]e {_FSF} 2 1"),
    ("lgpl-3.0", "lesser", rf"lesser general public licen[cs]e {_FSF} 3"),
    ("agpl-3.0", "affero", rf"affero general public licen[cs]e {_FSF} 3"),
    ("bsd", "redistribution", r"redistribution and use in source(?: and binary forms)?"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither", r"neither the name of(?: \w+){1,10} nor the names of its contributors"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "except", r"you may not use this file except in compliance with the license"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("proprietary", "reverse", r"may not reverse engineer decompile or disassemble"),
)

# Short names that are words of their own elsewhere: they count behind "licensed under" and the like only.
_FRAMED = (
    ("mit", "mit"), ("gpl", "gpl"), ("apache", "apache"), ("bsd", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("mpl", "mpl"),
    ("epl", "epl"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("x11", "x11"), ("ncsa", "ncsa"), ("unlicense", "unlicense"),
)

# Identifiers as tags write them (words, so 2.0 is "2 0"), each with the label it stands for.
_TAGS = (
    ("0bsd", "0bsd"), ("afl 3 0", "afl-3.0"), ("agpl 1 0", "agpl-1.0"), ("agpl 3 0", "agpl-3.0"),
    ("apache 1 1", "apache-1.1"), ("apache 2 0", "apache-2.0"), ("artistic 1 0", "artistic-1.0"),
    ("artistic 2 0", "artistic-2.0"), ("blueoak 1 0 0", "blueoak"), ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"), ("bsd 4 clause", "bsd-4-clause"), ("bsl 1 0", "bsl-1.0"),
    ("busl 1 1", "busl-1.1"), ("cc by 3 0", "cc-by"), ("cc by 4 0", "cc-by"), ("cc by nc 4 0", "cc-by-nc"),
    ("cc by nc nd 4 0", "cc-by-nc-nd"), ("cc by nc sa 4 0", "cc-by-nc-sa"), ("cc by nd 4 0", "cc-by-nd"),
    ("cc by sa 3 0", "cc-by-sa"), ("cc by sa 4 0", "cc-by-sa"), ("cc0 1 0", "cc0"), ("cddl 1 0", "cddl-1.0"),
    ("cddl 1 1", "cddl-1.1"), ("cecill 2 1", "cecill"), ("cpl 1 0", "cpl-1.0"), ("curl", "curl"),
    ("elastic 2 0", "elastic-2.0"), ("epl 1 0", "epl-1.0"), ("epl 2 0", "epl-2.0"), ("eupl 1 2", "eupl-1.2"),
    ("gfdl 1 3", "gfdl"), ("gpl 1 0", "gpl-1.0"), ("gpl 2 0", "gpl-2.0"), ("gpl 3 0", "gpl-3.0"), ("icu", "icu"),
    ("ipl 1 0", "ipl"), ("isc", "isc"), ("lgpl 2 0", "lgpl-2.0"), ("lgpl 2 1", "lgpl-2.1"), ("lgpl 3 0", "lgpl-3.0"),
    ("libpng", "libpng"), ("mit", "mit"), ("mit 0", "mit-0"), ("mpl 1 0", "mpl-1.0"), ("mpl 1 1", "mpl-1.1"),
    ("mpl 2 0", "mpl-2.0"), ("ms pl", "ms-pl"), ("ms rl", "ms-rl"), ("mulanpsl 2 0", "mulan"), ("ncsa", "ncsa"),
    ("npl 1 1", "npl"), ("ntp", "ntp"), ("odbl 1 0", "odbl"), ("odc by 1 0", "odc-by"), ("ofl 1 1", "ofl-1.1"),
    ("openssl", "openssl"), ("osl 3 0", "osl-3.0"), ("pddl 1 0", "pddl"), ("php 3 01", "php"),
    ("postgresql", "postgresql"), ("psf 2 0", "python"), ("python 2 0", "python"), ("qpl 1 0", "qpl"),
    ("rpl 1 5", "rpl"), ("ruby", "ruby"), ("sissl", "sissl"), ("sleepycat", "sleepycat"), ("spl 1 0", "spl"),
    ("sspl 1 0", "sspl"), ("unlicense", "unlicense"), ("upl 1 0", "upl"), ("vim", "vim"), ("w3c", "w3c"),
    ("wtfpl", "wtfpl"), ("x11", "x11"), ("zlib", "zlib"),
)

#: How sure a detection of each kind of rule is; the highest of a text is its score.
TAG, NOTICE, NAME = 1.0, 0.9, 0.7


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int  #: smaller wins
    score: float


@dataclass(frozen=True)
class Detection:
    first: int  #: first word
    last: int  #: last word
    label: str
    priority: int
    score: float


def _rule(label: str, keyword: str, body: str, priority: int, score: float) -> Rule:
    return Rule(label, keyword.encode(), re.compile(rf" (?:{body})(?= )".encode()), priority, score)


_UNDER = (r"(?:licen[cs]ed|released|distributed|available|provided|published|covered) under "
          r"(?:the )?(?:terms (?:of|and conditions of) (?:the )?)?")
# Earlier members of "A or B": the group `at` is set where the named licence isn't the first.
_OR_TAG = r"(?:(?: \w+){1,8} (?:or|and)(?P<at>))?"
_OR_SHORT = r"(?:(?:mit|l?gpl|apache|bsd|mpl|isc)\w*(?: \w+){0,4} (?:or|and)(?: the)?(?P<at>) )?"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signatures in order: identifier tags, notices with short names, notices, bare names; within each, as written."""
    out = [_rule(label, "spdx", rf"spdx license identifier{_OR_TAG} {tag}(?: only| or later)?", n, TAG)
           for n, (tag, label) in enumerate(_TAGS)]
    for label, short in _FRAMED:
        out.append(_rule(label, short.split()[0], rf"{_UNDER}{_OR_SHORT}{short}", len(out), NOTICE))
    for frame, score in ((rf"{_UNDER}(?:{{}})", NOTICE), (r"(?:{})", NAME)):
        for label, keyword, body in _NAMES:
            out.append(_rule(label, keyword, frame.replace("{}", body), len(out), score))
    return tuple(out)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword.decode(), []).append(i)
    for k, ids in by.items():
        a.add_word(f" {k}", ids)  # at the start of a word
    a.make_automaton()
    return a


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections by priority; one that touches the interval of an accepted one is dropped.

    First those whose interval lies inside that of a longer detection go, so that
    a version or a variant beats the family name in it; then priority decides
    among those that overlap in part or are equal.
    """
    by_start = sorted(set(found), key=lambda d: (d.first, -d.last, d.priority))
    outer, end = [], (-1, -1)
    for d in by_start:
        if d.last > end[1] or (d.first, d.last) == end:
            outer.append(d)
            end = (d.first, d.last)
    kept: list[Detection] = []
    chain: list[Detection] = []
    reach = -1
    for d in [*outer, None]:
        if d is None or d.first > reach:
            taken: list[Detection] = []
            for x in sorted(chain, key=lambda x: (x.priority, x.first)):
                if all(x.last < y.first or x.first > y.last for y in taken):
                    taken.append(x)
            kept += taken
            chain, reach = [], -1
        if d is not None:
            chain.append(d)
            reach = max(reach, d.last)
    return sorted(kept, key=lambda d: (d.first, d.priority))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PARTS).split()


def scan_text(text: str | None) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """(number of words, base places as (word, label), resolved detections)."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in BASE_PHRASES:
        body = f" {phrase} ".encode()
        places = _WordNumber(line)
        at = line.find(body)
        while at >= 0:
            base.append((places.at(at), label))
            at = line.find(body, at + 1)
    hits = {i for _, ids in _automaton().iter(line.decode("utf-8", "surrogatepass")) for i in ids}
    found = []
    for i in sorted(hits):
        r, places = rules()[i], _WordNumber(line)
        part = "at" in r.pattern.groupindex
        for m in r.pattern.finditer(line):
            start = max(m.start(), m.start("at")) if part else m.start()
            first = places.at(start)
            found.append(Detection(first, first + line.count(b" ", start, m.end()) - 1, r.label, r.priority, r.score))
    return len(words), sorted(base), resolve(found)


class _WordNumber:
    """Number of the word after each of a rising row of places; a line is counted once."""

    def __init__(self, line: bytes):
        self.line, self.done, self.n = line, 0, 0

    def at(self, place: int) -> int:
        self.n += self.line.count(b" ", self.done, place)
        self.done = place
        return self.n


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `licence`: n_words, base places, labels, detections, score.

    Null and empty texts have no words and no licence (score 0).  A text of any
    length is scanned whole, in time that grows with its words; a task holds one
    small batch of texts.  A base place alone scores 1.  A column called licence is replaced; repeated rows agree.
    """
    small_batches(docs.sparkSession)
    detection = "array<struct<first:long,last:long,label:string,score:double>>"

    @F.pandas_udf(f"n_words long, places array<long>, base_labels string, labels string, score double, detections {detection}")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part:
                n, base, found = scan_text(t if isinstance(t, str) else None)
                own = {x for _, x in base}
                rows.append((n, [p for p, _ in base], ",".join(sorted(own)), ",".join(sorted(own | {d.label for d in found})),
                             1.0 if base else max((d.score for d in found), default=0.0),
                             [{"first": d.first, "last": d.last, "label": d.label, "score": d.score} for d in found]))
            yield pd.DataFrame(rows, columns=["n_words", "places", "base_labels", "labels", "score", "detections"])

    return with_columns(docs, licence=find(F.col(f"`{text_col}`")))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    x = scan(docs.select("doc_id", "text"))
    return x.select("doc_id", F.col("licence.n_words").alias("n_words"),
                    F.size("licence.places").cast("long").alias("n_base"),
                    F.array_min("licence.places").alias("first_word"), F.array_max("licence.places").alias("last_word"),
                    F.col("licence.base_labels").alias("base_labels"), F.col("licence.labels").alias("labels"),
                    F.col("licence.score").alias("score"))
