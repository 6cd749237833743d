"""Signature rules for licence texts, in order: hand-written parts, put together by family.

A rule is (label, priority, keyword, opening, pattern). Patterns run over lower-cased text; a rule runs only on texts that hold its
keyword, and only on texts that match its opening behind anything but an ASCII letter or digit. Both are made from the words of the pattern:
every match of it has them. A lower priority number is stronger. No pattern matches more than ``LONGEST`` characters.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LONGEST = 400


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    opening: str
    pattern: str


#: Between two words of a phrase: anything that is no word character, as in wrapped or decorated comments.
_GAP = r"[^0-9a-z\x80-\x{10ffff}]{1,20}"
_B, _E = r"(?<![0-9a-z])", r"(?![0-9a-z])"


#: Words that many texts hold: a rule takes another for its keyword where it has one.
_ORDINARY = frozenset("a above business clause common creative modified organization provided released style subject all and any be by code copies copy distribute either except express for form free general granted have holder in included into is law license may modify must name names new not of open or person program public published required retain server shall side software source the this to under use version with without work writing you".split())


def _plain(text: str) -> str:
    return text.replace(".", r"\.")


def _keyword(text: str) -> str:
    """The literal opening of a word of ``text`` that every match of its pattern holds: a longest one, of those that are not ordinary if there are any."""
    fixed = [re.match(r"(?:[0-9a-z.](?!\?))*", w)[0] for w in text.split()]
    return max((w for w in fixed if w), key=lambda w: (w[0].isalpha() and w not in _ORDINARY, len(w)))


def _worded(label: str, priority: int, text: str, before: str = _B) -> Rule:
    keyword = _keyword(text)
    return Rule(label, priority, keyword, _plain(keyword), before + _GAP.join(_plain(text).split()) + _E)


def _placed(label: str, place: str) -> Rule:
    """A place may stand behind any character, so its opening is what follows its first dot."""
    host, rest = place.split(".", 1)
    return Rule(label, 3, place, rf"(?<={host}\.){_plain(rest)}", _plain(place))


#: label, names, SPDX identifiers, places on the web
_FAMILIES: list[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = [
    ("gpl", ("gnu gpl", "gpl v?2", "gpl v?3", "gplv2", "gplv3"), ("gpl-1.0", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later"), ("gnu.org/licenses/gpl",)),
    ("gpl", ("gnu general public licen[sc]e", "general public licen[sc]e version 2", "general public licen[sc]e version 3"), (), ()),
    ("lgpl", ("gnu lesser general public licen[sc]e", "lesser general public licen[sc]e"), (), ()),
    ("lgpl", ("gnu lgpl", "lgplv2", "lgplv3"), ("lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later"), ("gnu.org/licenses/lgpl",)),
    ("lgpl", ("gnu library general public licen[sc]e",), (), ()),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e"), (), ()),
    ("agpl", ("gnu agpl", "agplv3"), ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), ("gnu.org/licenses/agpl",)),
    ("gfdl", ("gnu free documentation licen[sc]e",), (), ()),
    ("gfdl", ("gnu fdl",), ("gfdl-1.1", "gfdl-1.2", "gfdl-1.3"), ("gnu.org/licenses/fdl",)),
    ("apache", ("apache licen[sc]e", "apache software licen[sc]e", "apache licen[sc]e version 2", "apache 2.0 licen[sc]e"), ("apache-1.0", "apache-1.1", "apache-2.0"), ("apache.org/licenses",)),
    ("mit", ("mit licen[sc]e", "the mit licen[sc]e", "mit style licen[sc]e", "mit x11 licen[sc]e"), ("mit", "mit-0"), ("opensource.org/licenses/mit",)),
    ("mit", ("expat licen[sc]e",), (), ()),
    ("x11", ("x11 licen[sc]e", "x consortium licen[sc]e"), ("x11",), ()),
    ("isc", ("isc licen[sc]e", "internet software consortium licen[sc]e"), ("isc",), ("opensource.org/licenses/isc",)),
    ("bsd", ("bsd licen[sc]e", "bsd style licen[sc]e", "new bsd licen[sc]e", "modified bsd licen[sc]e", "simplified bsd licen[sc]e"), ("0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause"), ("opensource.org/licenses/bsd",)),
    ("bsd", ("2 clause bsd", "3 clause bsd", "4 clause bsd"), (), ()),
    ("mpl", ("mozilla public licen[sc]e", "mozilla public licen[sc]e version 2"), (), ("mozilla.org/mpl",)),
    ("mpl", ("mpl 2.0",), ("mpl-1.0", "mpl-1.1", "mpl-2.0"), ()),
    ("epl", ("eclipse public licen[sc]e", "eclipse distribution licen[sc]e"), (), ("eclipse.org/legal",)),
    ("epl", (), ("epl-1.0", "epl-2.0"), ()),
    ("cddl", ("cddl licen[sc]e",), ("cddl-1.0", "cddl-1.1"), ()),
    ("cddl", ("common development and distribution licen[sc]e",), (), ()),
    ("cpl", ("common public licen[sc]e",), ("cpl-1.0",), ()),
    ("eupl", ("eupl licen[sc]e",), ("eupl-1.1", "eupl-1.2"), ()),
    ("eupl", ("european union public licen[sc]e",), (), ()),
    ("cc0", ("cc0 licen[sc]e", "cc0 1.0", "cc0 public domain"), ("cc0-1.0",), ("creativecommons.org/publicdomain/zero",)),
    ("cc-by", ("cc by", "cc by 2.0", "cc by 3.0", "cc by 4.0"), (), ()),
    ("cc-by", ("cc by licen[sc]e",), ("cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0"), ("creativecommons.org/licenses/by/",)),
    ("cc-by-sa", ("cc by sa", "cc by sa 3.0", "cc by sa 4.0"), ("cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0"), ("creativecommons.org/licenses/by-sa",)),
    ("cc-by-nc", ("cc by nc", "cc by nc 3.0", "cc by nc 4.0"), ("cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0"), ("creativecommons.org/licenses/by-nc/",)),
    ("cc-by-nd", ("cc by nd", "cc by nd 4.0"), ("cc-by-nd-3.0", "cc-by-nd-4.0"), ("creativecommons.org/licenses/by-nd",)),
    ("cc-by-nc-sa", ("cc by nc sa", "cc by nc sa 4.0"), ("cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"), ("creativecommons.org/licenses/by-nc-sa",)),
    ("cc-by-nc-nd", ("cc by nc nd", "cc by nc nd 4.0"), ("cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"), ("creativecommons.org/licenses/by-nc-nd",)),
    ("cc", ("creative commons licen[sc]e", "creative commons attribution", "creative commons attribution sharealike", "creative commons attribution noncommercial", "creative commons attribution noderivatives", "creative commons zero"), (), ("creativecommons.org/licenses",)),
    ("public-domain", ("in the public domain", "released into the public domain", "public domain dedication"), (), ()),
    ("unlicense", ("the unlicense",), ("unlicense",), ("unlicense.org",)),
    ("wtfpl", ("wtfpl licen[sc]e",), ("wtfpl",), ("wtfpl.net",)),
    ("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), ("zlib", "zlib-acknowledgement"), ()),
    ("boost", ("boost software licen[sc]e",), ("bsl-1.0",), ("boost.org/license",)),
    ("artistic", ("artistic licen[sc]e", "artistic licen[sc]e 2.0", "perl artistic licen[sc]e"), ("artistic-1.0", "artistic-2.0"), ()),
    ("python", ("python software foundation licen[sc]e", "psf licen[sc]e", "python licen[sc]e"), ("python-2.0", "psf-2.0"), ()),
    ("php", ("php licen[sc]e",), ("php-3.0", "php-3.01"), ()),
    ("ruby", ("ruby licen[sc]e",), ("ruby",), ()),
    ("openssl", ("openssl licen[sc]e",), ("openssl",), ()),
    ("postgresql", ("postgresql licen[sc]e",), ("postgresql",), ()),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("ofl-1.0", "ofl-1.1"), ()),
    ("odbl", ("open data commons", "open database licen[sc]e", "open data commons attribution"), ("odbl-1.0", "odc-by-1.0", "pddl-1.0"), ("opendatacommons.org/licenses",)),
    ("ncsa", ("ncsa open source licen[sc]e",), ("ncsa",), ()),
    ("afl", ("academic free licen[sc]e",), ("afl-3.0",), ()),
    ("osl", ("open software licen[sc]e",), ("osl-3.0",), ()),
    ("ms-pl", ("microsoft public licen[sc]e", "microsoft reciprocal licen[sc]e"), ("ms-pl", "ms-rl"), ()),
    ("busl", ("business source licen[sc]e",), ("busl-1.1",), ()),
    ("sspl", ("server side public licen[sc]e",), ("sspl-1.0",), ()),
    ("elastic", ("elastic licen[sc]e",), ("elastic-2.0",), ()),
    ("proprietary", ("all rights reserved",), (), ()),
    ("proprietary", ("proprietary and confidential", "proprietary licen[sc]e", "proprietary software"), (), ()),
]

#: Sentences of licence texts themselves: label, words.
_SENTENCES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("gpl", "published by the free software foundation either version"),
    ("lgpl", "this library is free software you can redistribute it and or modify"),
    ("apache", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "unless required by applicable law or agreed to in writing"),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e"),
    ("boost", "free of charge to any person or organization obtaining a copy of the software"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
]

#: Ways to say that a work is under a licence; any of them before a name is a stronger rule than the name alone.
_LEADS = ("licen[sc]ed under", "released under", "distributed under", "available under", "under the terms of")


def rules() -> list[Rule]:
    """All rules in order of priority: licence sentences, declared SPDX tags, declarations, bare tags and places, names."""
    found = [_worded(label, 0, words) for label, words in _SENTENCES]
    for label, names, spdx, places in _FAMILIES:
        found += [Rule(label, 1, "spdx-license-identifier:", "license-identifier:", r"spdx-license-identifier:[ \t]{0,8}" + _plain(s) + r"(?![0-9a-z.\-])") for s in spdx]
        lead = _B + "(?:" + "|".join(_GAP.join(x.split()) for x in _LEADS) + ")" + _GAP + "(?:the" + _GAP + ")?"
        found += [_worded(label, 2, n, lead) for n in names]
        found += [Rule(label, 3, s, _plain(s), r"(?<![0-9a-z.\-])" + _plain(s) + r"(?![0-9a-z.\-])") for s in spdx if "-" in s]
        found += [_placed(label, p) for p in places]
        found += [_worded(label, 4, n) for n in names]
    return sorted(dict.fromkeys(found), key=lambda r: r.priority)


#: Share of certainty that a detection of each priority gives.
CERTAINTY = {0: 0.95, 1: 1.0, 2: 0.9, 3: 0.8, 4: 0.6}
