"""The signature rules of the license scan, in order.

Fixed values, written by hand. A line is a rule: label, priority, score and a pattern of lower-case words;
lines stand under the words of which every match of theirs holds one part: the root, by which a text is
first told apart, and after a colon the keyword that must occur too. Priorities: 100 base phrases, 90
identifiers, 80 grants and full notices, 70 titles with a version, 60 titles, 50 loose names, 30 hints.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches whole words; ``root`` and ``keyword`` are part of all it matches."""

    label: str
    root: str
    keyword: str
    pattern: str
    priority: int
    score: float
    base: bool = False


#: The contract's phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_BASE_ROOTS = ("licen", "licen", "cc by")

RULES = """
spdx: identifier mit
mit 90 1 spdx license identifier mit
mit-0 90 1 spdx license identifier mit 0
spdx: identifier apache
apache-1.1 90 1 spdx license identifier apache 1 1
apache-2 90 1 spdx license identifier apache 2 0
spdx: identifier gpl
gpl-1 90 1 spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 90 1 spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later 90 1 spdx license identifier gpl 2 0 or later
gpl-3 90 1 spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later 90 1 spdx license identifier gpl 3 0 or later
spdx: identifier lgpl
lgpl-2 90 1 spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 90 1 spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 90 1 spdx license identifier lgpl 3 0(?: only| or later)?
spdx: identifier agpl
agpl-1 90 1 spdx license identifier agpl 1 0(?: only| or later)?
agpl-3 90 1 spdx license identifier agpl 3 0(?: only| or later)?
spdx: identifier gfdl
gfdl 90 1 spdx license identifier gfdl 1 [123](?: only| or later)?
spdx: identifier bsd
bsd-1 90 1 spdx license identifier bsd 1 clause
bsd-2 90 1 spdx license identifier bsd 2 clause
bsd-2-patent 90 1 spdx license identifier bsd 2 clause patent
bsd-3 90 1 spdx license identifier bsd 3 clause
bsd-3-clear 90 1 spdx license identifier bsd 3 clause clear
bsd-4 90 1 spdx license identifier bsd 4 clause
spdx: identifier 0bsd
0bsd 90 1 spdx license identifier 0bsd
spdx: identifier isc
isc 90 1 spdx license identifier isc
spdx: identifier mpl
mpl-1.1 90 1 spdx license identifier mpl 1 1
mpl-2 90 1 spdx license identifier mpl 2 0
spdx: identifier epl
epl-1 90 1 spdx license identifier epl 1 0
epl-2 90 1 spdx license identifier epl 2 0
spdx: identifier eupl
eupl-1.1 90 1 spdx license identifier eupl 1 1
eupl-1.2 90 1 spdx license identifier eupl 1 2
spdx: identifier cddl
cddl-1 90 1 spdx license identifier cddl 1 [01]
spdx: identifier cecill
cecill-2.1 90 1 spdx license identifier cecill 2 1
cecill-b 90 1 spdx license identifier cecill b
cecill-c 90 1 spdx license identifier cecill c
spdx: identifier artistic
artistic-1 90 1 spdx license identifier artistic 1 0
artistic-2 90 1 spdx license identifier artistic 2 0
spdx: identifier zlib
zlib 90 1 spdx license identifier zlib
spdx: identifier bsl
boost-1 90 1 spdx license identifier bsl 1 0
spdx: identifier unlicense
unlicense 90 1 spdx license identifier unlicense
spdx: identifier wtfpl
wtfpl 90 1 spdx license identifier wtfpl
spdx: identifier psf
python-2 90 1 spdx license identifier psf 2 0
spdx: identifier cc0
cc0 90 1 spdx license identifier cc0 1 0
spdx: identifier cc by
cc-by 90 1 spdx license identifier cc by [1-4] [05]
cc-by-sa 90 1 spdx license identifier cc by sa [1-4] [05]
cc-by-nd 90 1 spdx license identifier cc by nd [1-4] [05]
cc-by-nc 90 1 spdx license identifier cc by nc [1-4] [05]
cc-by-nc-sa 90 1 spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd 90 1 spdx license identifier cc by nc nd [1-4] [05]
spdx: identifier odbl
odbl-1 90 1 spdx license identifier odbl 1 0
spdx: identifier ofl
ofl-1.1 90 1 spdx license identifier ofl 1 1(?: rfn| no rfn)?
spdx: identifier ms
ms-pl 90 1 spdx license identifier ms pl
ms-rl 90 1 spdx license identifier ms rl
spdx: identifier busl
busl-1.1 90 1 spdx license identifier busl 1 1
spdx: identifier sspl
sspl-1 90 1 spdx license identifier sspl 1 0
spdx: identifier elastic
elastic-2 90 1 spdx license identifier elastic 2 0
spdx: identifier upl
upl-1 90 1 spdx license identifier upl 1 0
spdx: identifier ecl
ecl-2 90 1 spdx license identifier ecl 2 0
spdx: identifier osl
osl-3 90 1 spdx license identifier osl 3 0
spdx: identifier afl
afl-3 90 1 spdx license identifier afl 3 0
spdx: identifier ncsa
ncsa 90 1 spdx license identifier ncsa
spdx: identifier openssl
openssl 90 1 spdx license identifier openssl
spdx: identifier postgresql
postgresql 90 1 spdx license identifier postgresql
spdx: identifier ruby
ruby 90 1 spdx license identifier ruby
spdx: identifier php
php-3 90 1 spdx license identifier php 3 01?
spdx: identifier vim
vim 90 1 spdx license identifier vim
spdx: identifier blueoak
blueoak-1 90 1 spdx license identifier blueoak 1 0 0
licen: mit
mit 80 0.98 (?:dual )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
mit 80 0.97 (?:released|distributed|published|available|provided|shared) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit 70 0.95 (?:terms|conditions) of the mit licen[sc]e
mit 60 0.9 (?:governed|covered|protected) by the mit licen[sc]e
mit 60 0.9 subject to the mit licen[sc]e
mit 60 0.9 licen[sc]e mit
mit 50 0.85 mit licen[sc]e
mit-0 70 0.95 mit no attribution licen[sc]e
mit-0 60 0.9 mit licen[sc]e without attribution
mit-or-apache-2 80 0.97 licen[sc]ed under (?:either (?:of )?)?(?:the )?mit or (?:the )?apache(?: 2 0)?(?: licen[sc]e)?
mit-or-apache-2 80 0.97 licen[sc]e mit or apache 2 0
x11 60 0.9 x11 mit licen[sc]e
licen: expat
mit 80 0.97 licen[sc]ed under (?:the )?(?:terms of (?:the )?)?expat(?: licen[sc]e)?
mit 60 0.9 (?:under )?the expat licen[sc]e
mit 50 0.85 expat licen[sc]e
licen: x11
x11 60 0.9 (?:the )?x11 licen[sc]e
licen: apache
apache-1 70 0.95 apache(?: software)? licen[sc]e(?: version| v)? 1(?: 0)
apache-1.1 70 0.95 apache(?: software)? licen[sc]e(?: version| v)? 1 1
apache-2 80 0.98 licen[sc]ed under the apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2 80 0.97 (?:released|distributed|published|available|provided|shared) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2 70 0.95 apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2 70 0.95 apache 2(?: 0)? licen[sc]e
apache-2 70 0.95 apache licen[sc]e v2(?: 0)?
apache-2 60 0.9 apache licen[sc]ed
apache 60 0.85 licen[sc]ed under (?:the )?apache(?: licen[sc]e)?
apache 50 0.8 apache(?: software)? licen[sc]e
apache-2-llvm 80 0.97 apache licen[sc]e(?: v2 0| version 2 0)? with llvm exceptions
licen: gnu general public
gpl-1 70 0.95 gnu general public licen[sc]e(?: version| v)? 1(?: 0)?
gpl-2 80 0.97 licen[sc]ed under the (?:terms of the )?gnu general public licen[sc]e(?: version| v)? 2(?: 0)?
gpl-2 70 0.95 gnu general public licen[sc]e(?: version| v)? 2(?: 0)?(?: only)?
gpl-2-or-later 80 0.97 gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-2-or-later 75 0.96 gnu general public licen[sc]e(?: version| v)? 2(?: 0)? or(?: any)? later(?: version)?
gpl-3 80 0.97 licen[sc]ed under the (?:terms of the )?gnu general public licen[sc]e(?: version| v)? 3(?: 0)?
gpl-3 70 0.95 gnu general public licen[sc]e(?: version| v)? 3(?: 0)?(?: only)?
gpl-3-or-later 80 0.97 gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-3-or-later 75 0.96 gnu general public licen[sc]e(?: version| v)? 3(?: 0)? or(?: any)? later(?: version)?
gpl 60 0.85 (?:a copy of )?the gnu general public licen[sc]e
gpl 50 0.8 gnu general public licen[sc]e
licen: gnu lesser
lgpl-2.1 70 0.95 gnu lesser general public licen[sc]e(?: version| v)? 2 1
lgpl-3 70 0.95 gnu lesser general public licen[sc]e(?: version| v)? 3(?: 0)?
lgpl-2.1-or-later 75 0.96 gnu lesser general public licen[sc]e(?: version| v)? 2 1 or(?: any)? later(?: version)?
lgpl 50 0.8 gnu lesser general public licen[sc]e
licen: gnu library
lgpl-2 70 0.95 gnu library general public licen[sc]e(?: version| v)? 2(?: 0)?
lgpl-2 50 0.8 gnu library general public licen[sc]e
licen: affero
agpl-3 70 0.95 gnu affero general public licen[sc]e(?: version| v)? 3(?: 0)?
agpl-3-or-later 75 0.96 gnu affero general public licen[sc]e(?: version| v)? 3(?: 0)? or(?: any)? later(?: version)?
agpl 50 0.8 (?:gnu )?affero general public licen[sc]e
licen: gnu free documentation
gfdl-1.2 70 0.95 gnu free documentation licen[sc]e(?: version| v)? 1 2
gfdl-1.3 70 0.95 gnu free documentation licen[sc]e(?: version| v)? 1 3
gfdl 50 0.85 gnu free documentation licen[sc]e
licen: lgpl
lgpl-2.1 80 0.96 licen[sc]ed under (?:the )?lgpl(?: version| v)? ?2 1
lgpl-3 80 0.96 licen[sc]ed under (?:the )?lgpl(?: version| v)? ?3(?: 0)?
lgpl 60 0.85 licen[sc]ed under (?:the )?(?:gnu )?lgpl
lgpl 50 0.8 (?:gnu )?lgpl licen[sc]e
licen: agpl
agpl-3 80 0.96 licen[sc]ed under (?:the )?(?:gnu )?agpl(?: version| v)? ?3(?: 0)?
agpl 60 0.85 licen[sc]ed under (?:the )?(?:gnu )?agpl
agpl 50 0.8 (?:gnu )?agpl licen[sc]e
licen: gpl
gpl-2 80 0.96 licen[sc]ed under (?:the )?(?:gnu )?gpl(?: version| v)? ?2(?: 0)?
gpl-3 80 0.96 licen[sc]ed under (?:the )?(?:gnu )?gpl(?: version| v)? ?3(?: 0)?
gpl-2 70 0.93 gpl(?: version| v)? ?2(?: 0)? licen[sc]e
gpl-3 70 0.93 gpl(?: version| v)? ?3(?: 0)? licen[sc]e
gpl 60 0.85 licen[sc]ed under (?:the )?(?:gnu )?gpl
gpl 50 0.8 (?:gnu )?gpl licen[sc]e
licen: bsd
bsd-2 70 0.95 (?:2|two) clause bsd licen[sc]e
bsd-2 70 0.95 bsd (?:2|two) clause licen[sc]e
bsd-2 70 0.93 (?:simplified|freebsd) bsd licen[sc]e
bsd-3 70 0.95 (?:3|three) clause bsd licen[sc]e
bsd-3 70 0.95 bsd (?:3|three) clause licen[sc]e
bsd-3 70 0.93 (?:new|modified|revised) bsd licen[sc]e
bsd-4 70 0.95 (?:4|four) clause bsd licen[sc]e
bsd-4 70 0.95 bsd (?:4|four) clause licen[sc]e
bsd-4 70 0.93 (?:original|old) bsd licen[sc]e
0bsd 70 0.95 (?:zero clause|0 clause|free public) bsd licen[sc]e
0bsd 70 0.95 bsd zero clause licen[sc]e
bsd 60 0.88 licen[sc]ed under (?:the )?(?:terms of (?:the )?)?bsd(?: licen[sc]e)?
bsd 60 0.87 (?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?bsd licen[sc]e
bsd 50 0.8 bsd (?:style )?licen[sc]e
licen: isc
isc 70 0.93 licen[sc]ed under (?:the )?(?:terms of (?:the )?)?isc(?: licen[sc]e)?
isc 50 0.8 isc licen[sc]e
licen: mozilla
mpl-1 70 0.95 mozilla public licen[sc]e(?: version| v)? 1 0
mpl-1.1 70 0.95 mozilla public licen[sc]e(?: version| v)? 1 1
mpl-2 80 0.97 (?:subject to|licen[sc]ed under) the (?:terms of the )?mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl-2 70 0.95 mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl 50 0.8 mozilla public licen[sc]e
licen: eclipse
epl-1 70 0.95 eclipse public licen[sc]e(?: version| v)? 1(?: 0)?
epl-2 70 0.95 eclipse public licen[sc]e(?: version| v)? 2(?: 0)?
epl 50 0.8 eclipse public licen[sc]e
edl-1 70 0.95 eclipse distribution licen[sc]e(?: version| v)? 1(?: 0)?
licen: european union
eupl-1.1 70 0.95 european union public licen[sc]e(?: version| v)? 1 1
eupl-1.2 70 0.95 european union public licen[sc]e(?: version| v)? 1 2
eupl 50 0.8 european union public licen[sc]e
licen: common development
cddl-1 70 0.95 common development and distribution licen[sc]e(?: version| v)? 1 [01]
cddl 50 0.85 common development and distribution licen[sc]e
licen: common public
cpl-1 60 0.9 common public licen[sc]e(?: version| v)? 1(?: 0)?
cpl 50 0.8 common public licen[sc]e
licen: cecill
cecill 50 0.85 cecill(?: [bc]| 2 [01])? licen[sc]e
licen: artistic
artistic-1 70 0.95 artistic licen[sc]e(?: version| v)? 1(?: 0)?
artistic-2 70 0.95 artistic licen[sc]e(?: version| v)? 2(?: 0)?
artistic 50 0.8 (?:the )?(?:clarified )?artistic licen[sc]e
licen: perl
perl 60 0.9 same terms as perl (?:itself )?licen[sc]e
licen: zlib
zlib 60 0.9 zlib(?: libpng)? licen[sc]e
licen: libpng
libpng 60 0.9 libpng licen[sc]e
licen: png reference
libpng 60 0.9 png reference library licen[sc]e
licen: boost
boost-1 70 0.95 boost software licen[sc]e(?: version| v)?(?: 1 0)?
licen: unlicense
unlicense 60 0.9 (?:under )?the unlicense
unlicense 80 0.97 licen[sc]ed under the unlicense
licen: wtfpl
wtfpl 60 0.9 licen[sc]ed under (?:the )?wtfpl
wtfpl 60 0.9 wtfpl licen[sc]e
licen: do what the
wtfpl 70 0.95 do what the fuck you want to public licen[sc]e
licen: python
python-2 70 0.95 python software foundation licen[sc]e(?: version| v)?(?: 2)?
python-2 60 0.9 psf licen[sc]e for python
python 50 0.8 python licen[sc]e
licen: open database
odbl-1 70 0.95 open database licen[sc]e(?: version| v)?(?: 1 0)?
licen: open data commons
odc-by-1 70 0.95 open data commons attribution licen[sc]e
pddl-1 70 0.95 open data commons public domain dedication and licen[sc]e
licen: open font
ofl-1.1 70 0.95 sil open font licen[sc]e(?: version| v)?(?: 1 1)?
ofl 60 0.9 open font licen[sc]e
licen: microsoft
ms-pl 70 0.95 microsoft public licen[sc]e
ms-rl 70 0.95 microsoft reciprocal licen[sc]e
licen: business source
busl-1.1 70 0.95 business source licen[sc]e(?: version| v)?(?: 1 1)?
licen: server side
sspl-1 70 0.95 server side public licen[sc]e(?: version| v)?(?: 1)?
licen: elastic
elastic-2 70 0.95 elastic licen[sc]e(?: version| v)?(?: 2(?: 0)?)?
licen: universal permissive
upl-1 70 0.95 universal permissive licen[sc]e(?: version| v)?(?: 1 0)?
licen: educational community
ecl-2 70 0.95 educational community licen[sc]e(?: version| v)?(?: 2 0)?
licen: open software
osl-3 70 0.95 open software licen[sc]e(?: version| v)?(?: 3 0)?
licen: academic free
afl-3 70 0.95 academic free licen[sc]e(?: version| v)?(?: 3 0)?
licen: illinois
ncsa 70 0.95 university of illinois ncsa open source licen[sc]e
licen: openssl
openssl 60 0.9 openssl (?:and ssleay )?licen[sc]e
licen: postgresql
postgresql 60 0.9 postgresql licen[sc]e
licen: ruby
ruby 60 0.9 (?:same terms as )?ruby licen[sc]e
licen: php
php-3 60 0.9 php licen[sc]e(?: version| v)?(?: 3 01?)?
licen: vim
vim 60 0.9 vim licen[sc]e
licen: w3c
w3c 60 0.9 w3c software (?:notice and )?licen[sc]e
licen: unicode
unicode 60 0.9 unicode(?: data files and software)? licen[sc]e
licen: blue oak
blueoak-1 70 0.95 blue oak model licen[sc]e(?: 1 0 0)?
licen: mulan
mulan-2 70 0.95 mulan psl(?: v2)? licen[sc]e
licen: hippocratic
hippocratic 60 0.9 hippocratic licen[sc]e
licen: llama
llama 60 0.9 llama (?:[234] )?community licen[sc]e
licen: rail
openrail 60 0.9 (?:open ?rail|bigscience rail) licen[sc]e
licen: creative commons
cc0 70 0.95 creative commons (?:cc0|zero)(?: 1 0)?(?: universal)? licen[sc]e
cc-by 70 0.95 creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e
cc-by-sa 70 0.95 creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e
cc-by-nd 70 0.95 creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e
cc-by-nc 70 0.95 creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e
cc-by-nc-sa 70 0.95 creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e
cc-by-nc-nd 70 0.95 creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e
cc 50 0.75 creative commons licen[sc]e
licen: commercial
commercial 50 0.7 commercial licen[sc]e agreement
licen: end user
eula 50 0.7 end user licen[sc]e agreement
licen: royalty free
royalty-free 30 0.6 (?:perpetual )?(?:non exclusive )?royalty free licen[sc]e
licen: licen
see-license 30 0.4 see (?:the )?licen[sc]e(?: file)? (?:for details|in the project root)
creative: creative commons attribution
cc-by 60 0.9 creative commons attribution(?: [1-4] [05])
cc-by-sa 60 0.9 creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nd 60 0.9 creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?
cc-by-nc 60 0.9 creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc-sa 60 0.9 creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd 60 0.9 creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?
cc by: cc by
cc-by 40 0.85 cc by [1-4] [05]
cc-by 30 0.7 cc by
cc-by-sa 60 0.9 cc by sa(?: [1-4] [05])?
cc-by-nd 60 0.9 cc by nd(?: [1-4] [05])?
cc-by-nc 60 0.9 cc by nc(?: [1-4] [05])?
cc-by-nc-sa 70 0.92 cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd 70 0.92 cc by nc nd(?: [1-4] [05])?
cc0: cc0
cc0 50 0.85 cc0(?: 1 0)?(?: universal)?
gpl: lgpl
lgpl-2 40 0.8 lgpl(?: version| v)? ?2(?: 0)?
lgpl-2.1 50 0.85 lgpl(?: version| v)? ?2 1
lgpl-3 40 0.8 lgpl(?: version| v)? ?3(?: 0)?
gpl: agpl
agpl-3 40 0.8 agpl(?: version| v)? ?3(?: 0)?
gpl: gpl
gpl-2 40 0.8 (?:gnu )?gpl(?: version| v)? ?2(?: 0)?
gpl-3 40 0.8 (?:gnu )?gpl(?: version| v)? ?3(?: 0)?
gpl-2 40 0.8 gplv2
gpl-3 40 0.8 gplv3
clause: clause bsd
bsd-2 40 0.8 (?:2|two) clause bsd
bsd-3 40 0.8 (?:3|three) clause bsd
clause: bsd
bsd-2 40 0.8 bsd (?:2|two) clause
bsd-3 40 0.8 bsd (?:3|three) clause
bsd-4 40 0.8 bsd (?:4|four) clause
apache: apache 2
apache-2 40 0.8 apache 2(?: 0)?
permission: hereby granted
mit 80 0.97 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
x11 80 0.95 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the x consortium
mit 60 0.85 permission is hereby granted free of charge
boost-1 80 0.97 permission is hereby granted free of charge to any person or organization obtaining a copy of the software
hpnd 70 0.9 permission is hereby granted without written agreement and without licen[sc]e
permission: permission to use copy modify
isc 80 0.95 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd 60 0.85 permission to use copy modify and or distribute this software for any purpose with or without fee
hpnd 70 0.9 permission to use copy modify and distribute this software and its documentation for any purpose
permission: verbatim copies
gpl 50 0.7 permission to copy and distribute verbatim copies
gfdl 60 0.8 permission is granted to copy distribute and or modify this document and verbatim copies
permission: prior written permission
no-reuse 30 0.5 without (?:the )?(?:express )?prior written permission
redistribution: source and binary forms
bsd 70 0.9 redistribution and use in source and binary forms with or without modification are permitted
bsd 50 0.8 redistribution and use in source and binary forms
redistribution: redistributions
bsd 40 0.7 redistributions? of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions
free software: free software
gpl 60 0.8 this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl 30 0.6 this program is free software you can redistribute it
lgpl 60 0.8 this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
lgpl 30 0.6 this library is free software you can redistribute it
perl 60 0.85 this (?:library|module|program) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself
warranty: altered source versions
zlib 80 0.95 altered source versions must be plainly marked as such and must not be misrepresented as being the original software this software is provided as is without any express or implied warranty
warranty: express or implied warranty
zlib 50 0.75 this software is provided as is without any express or implied warranty
warranty: without warranty of any kind
as-is 30 0.5 provided as is without warranty of any kind
as-is 30 0.5 without warranty of any kind
public domain: public domain
public-domain 70 0.9 (?:dedicated|released) (?:in)?to the public domain
public-domain 70 0.9 (?:placed|put) (?:in|into) the public domain
public-domain 70 0.9 free and unencumbered software released into the public domain
unlicense 80 0.95 this is free and unencumbered software released into the public domain
public-domain 60 0.85 (?:is|are) in the public domain
public-domain 50 0.8 in the public domain
public-domain 60 0.85 public domain dedication
pddl-1 60 0.85 public domain dedication and licen[sc]e
public-domain 60 0.85 no known copyright public domain mark
rights reserved: all rights reserved
all-rights-reserved 30 0.6 all rights reserved
rights reserved: some rights reserved
some-rights-reserved 30 0.5 some rights reserved
copyright: copyright
copyright 30 0.5 copyright(?: c)? (?:19|20)[0-9][0-9]
copyright 30 0.5 (?:19|20)[0-9][0-9] copyright holders?
proprietary: proprietary
proprietary 60 0.8 proprietary and confidential
proprietary 60 0.8 confidential and proprietary
proprietary 50 0.7 proprietary licen[sc]e
proprietary: trade secret
proprietary 50 0.7 proprietary (?:information|material) (?:and|or) trade secrets?
confidential: unauthorized copying
proprietary 70 0.9 unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential
prohibited: strictly prohibited
no-reuse 30 0.5 unauthorized (?:copying|use|distribution|reproduction)(?: or (?:use|distribution|reproduction))? (?:of this (?:file|software|document) )?is strictly prohibited
for internal use: for internal use only
internal 30 0.5 for internal use only
non commercial: non commercial
non-commercial 50 0.7 (?:free )?for non commercial (?:use|purposes)(?: only)?
non-commercial 50 0.7 non commercial use only
noncommercial: noncommercial
non-commercial 50 0.7 (?:free )?for noncommercial (?:use|purposes)(?: only)?
research purposes: research purposes
research-only 50 0.7 for (?:academic|research|non commercial research) (?:and|or) research purposes only
research-only 50 0.7 for research purposes only
"""


def license_rules() -> list[Rule]:
    """All rules in order: base phrases, then those of ``RULES``."""
    rules = [Rule(label, root, phrase, phrase, 100, 1.0, True) for (phrase, label), root in zip(BASE.items(), _BASE_ROOTS)]
    for line in RULES.strip().splitlines():
        if head := re.fullmatch("([a-z0-9 ]+): ([a-z0-9 ]+)", line):
            root, keyword = head.groups()
        else:
            label, priority, score, pattern = line.split(" ", 3)
            rules.append(Rule(label, root, keyword, pattern, int(priority), float(score)))
    return rules
