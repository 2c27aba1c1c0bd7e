"""Signatures of licences, written over words: lower-case, without punctuation, one space apart.

A licence has a label, keyword words of which a text must hold one before the
expression is tried, and an expression for its name.  Each makes three rules:
its SPDX tag, a sentence that grants it, and its name.  Sentences of licence
texts are rules of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

_V = "(?:version |v )?"
_LIC = "licen[cs]es?"
_OPT = f"(?: {_LIC})?"
_CC = "(?:creative commons |cc )(?:licen[cs]e )?"

#: label | keywords | name, in the order of the rules: a licence's versions come before its family.
LICENCES = f"""
mit-0 | mit | mit (?:no attribution|0){_OPT}
mit | mit expat | (?:mit|expat)(?: x11| style| type)? {_LIC}
x11 | x11 | x11 {_LIC}
isc | isc | (?:isc|internet systems consortium|internet software consortium) {_LIC}
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd){_OPT}
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|three clause bsd){_OPT}
bsd-2-clause | bsd freebsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd){_OPT}
0bsd | bsd 0bsd | (?:0bsd|zero clause bsd|bsd zero clause){_OPT}
bsd | bsd | bsd(?: style| type)? {_LIC}
apache-1.0 | apache asl | (?:apache(?: software)?|asl){_OPT} {_V}1 0
apache-1.1 | apache asl | (?:apache(?: software)?|asl){_OPT} {_V}1 1
apache-2.0 | apache asl apache2 asl2 | (?:apache(?: software)?{_OPT} (?:{_V}2(?: 0)?|v2(?: 0)?)|apache2|asl {_V}2(?: 0)?|asl2)
apache | apache | apache(?: software)? {_LIC}
agpl-1.0 | agpl affero | (?:agpl|affero general public license) {_V}1(?: 0)?
agpl-3.0 | agpl agplv3 agpl3 affero | (?:agplv3|agpl3|agpl {_V}3(?: 0)?|(?:gnu )?affero (?:gpl|general public license) {_V}3(?: 0)?)
agpl | agpl affero | (?:gnu )?(?:agpl|affero (?:gpl|general public license))
lgpl-2.0 | lgpl lgplv2 library | (?:lgplv2|lgpl {_V}2(?: 0)?|(?:gnu )?library general public license {_V}2(?: 0)?)
lgpl-2.1 | lgpl lgplv2 lesser | (?:lgplv2 1|lgpl {_V}2 1|(?:gnu )?lesser (?:gpl|general public license) {_V}2 1)
lgpl-3.0 | lgpl lgplv3 lgpl3 lesser | (?:lgplv3|lgpl3|lgpl {_V}3(?: 0)?|(?:gnu )?lesser (?:gpl|general public license) {_V}3(?: 0)?)
lgpl | lgpl lesser | (?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public license))
gpl-1.0 | gpl gnu general | (?:gpl|(?:gnu )?general public license) {_V}1(?: 0)?
gpl-2.0 | gpl gplv2 gpl2 gnu general | (?:gplv2|gpl2|gpl {_V}2(?: 0)?|(?:gnu )?(?:gpl|general public license) {_V}2(?: 0)?)
gpl-3.0 | gpl gplv3 gpl3 gnu general | (?:gplv3|gpl3|gpl {_V}3(?: 0)?|(?:gnu )?(?:gpl|general public license) {_V}3(?: 0)?)
gpl | gpl gnu general | (?:(?:gnu )?general public licen[cs]e|gnu gpl|gpl{_OPT})
gfdl-1.1 | gfdl gnu | (?:gfdl|(?:gnu )?free documentation license) {_V}1 1
gfdl-1.2 | gfdl gnu | (?:gfdl|(?:gnu )?free documentation license) {_V}1 2
gfdl-1.3 | gfdl gnu | (?:gfdl|(?:gnu )?free documentation license) {_V}1 3
gfdl | gfdl gnu | (?:gfdl|gnu free documentation license)
mpl-1.0 | mpl mozilla | (?:mpl|mozilla public license) {_V}1 0
mpl-1.1 | mpl mozilla | (?:mpl|mozilla public license) {_V}1 1
mpl-2.0 | mpl mplv2 mozilla | (?:mplv2|(?:mpl|mozilla public license) {_V}2(?: 0)?)
mpl | mozilla | mozilla public licen[cs]e
epl-1.0 | epl eclipse | (?:epl|eclipse public license) {_V}1(?: 0)?
epl-2.0 | epl eclipse | (?:epl|eclipse public license) {_V}2(?: 0)?
epl | eclipse | eclipse public licen[cs]e
edl-1.0 | eclipse | eclipse distribution license(?: {_V}1 0)?
cddl-1.0 | cddl | (?:cddl|common development and distribution license cddl) {_V}1 0
cddl-1.1 | cddl | (?:cddl|common development and distribution license cddl) {_V}1 1
cddl | cddl | (?:common development and distribution license )?cddl
cpl-1.0 | cpl common | (?:common public license(?: {_V}1 0)?|cpl {_V}1 0)
ipl-1.0 | ibm | ibm public license(?: {_V}1 0)?
spl-1.0 | sun | sun public license(?: {_V}1 0)?
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd | cc creative | {_CC}(?:by nc nd|attribution non ?commercial no deriv(?:ative)?s?)(?: [1-4] [05])?
cc-by-nc-sa | cc creative | {_CC}(?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] [05])?
cc-by-nc | cc creative | {_CC}(?:by nc|attribution non ?commercial)(?: [1-4] [05])?
cc-by-nd | cc creative | {_CC}(?:by nd|attribution no deriv(?:ative)?s?)(?: [1-4] [05])?
cc-by-sa | cc creative | {_CC}(?:by sa|attribution share ?alike)(?: [1-4] [05])?
cc-by | cc creative | {_CC}(?:by|attribution)(?: [1-4] [05])?
cc | creative | creative commons {_LIC}
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | (?:do what the f[a-z]+ you want to public license )?wtfpl
zlib | zlib | zlib(?: libpng)? {_LIC}
libpng-2.0 | libpng | (?:png reference library|libpng) {_LIC}(?: {_V}2)?
bsl-1.0 | boost | boost software license(?: {_V}1 0)?
artistic-1.0 | artistic | (?:perl )?artistic license {_V}1 0
artistic-2.0 | artistic | (?:perl )?artistic license {_V}2(?: 0)?
artistic | artistic | (?:perl )?artistic licen[cs]e
psf-2.0 | python psf | (?:python software foundation|psf)(?: license)?(?: agreement)?(?: {_V}2(?: 0)?)
python | python psf | (?:python(?: software foundation)?|psf) {_LIC}
php-3.01 | php | php license {_V}3(?: 01)?
php | php | php licen[cs]e
ruby | ruby | ruby {_LIC}
openssl | openssl | openssl {_LIC}
eupl-1.1 | eupl european | (?:eupl|european union public licen[cs]e) {_V}1 1
eupl-1.2 | eupl european | (?:eupl|european union public licen[cs]e) {_V}1 2
eupl | eupl european | (?:eupl|european union public licen[cs]e)
osl-3.0 | osl open | (?:open software license|osl) {_V}3(?: 0)?
afl-3.0 | afl academic | (?:academic free license|afl) {_V}3(?: 0)?
ecl-2.0 | educational | educational community license(?: {_V}2(?: 0)?)?
ms-pl | microsoft | microsoft public license(?: ms pl)?
ms-rl | microsoft | microsoft reciprocal license(?: ms rl)?
ofl-1.1 | ofl sil | (?:sil open font license(?: {_V}1 1)?|ofl {_V}1 1)
postgresql | postgresql | postgresql {_LIC}
ncsa | ncsa illinois | (?:university of illinois ncsa|ncsa)(?: open source)? {_LIC}
unicode-3.0 | unicode | unicode {_LIC} v3
unicode | unicode | unicode(?: inc)? {_LIC}(?: agreement)?
w3c | w3c | w3c(?: software(?: notice)?(?: and)?(?: document)?)? {_LIC}
vim | vim | vim {_LIC}
tcl | tcl | tcl(?: tk)? {_LIC}
sleepycat | sleepycat | sleepycat(?: public)? {_LIC}
sspl-1.0 | sspl server | (?:sspl(?: {_V}1(?: 0)?)?|server side public license(?: {_V}1(?: 0)?)?)
busl-1.1 | busl business | (?:busl(?: 1 1)?|business source license(?: {_V}1 1)?)
elastic-2.0 | elastic | elastic license(?: {_V}2(?: 0)?)?
odbl-1.0 | odbl database | (?:odbl|open (?:data commons open )?database license)(?: {_V}1 0)?
odc-by-1.0 | odc | (?:odc by|open data commons attribution license)(?: {_V}1 0)?
pddl-1.0 | pddl | (?:open data commons public domain dedication and license )?pddl(?: {_V}1 0)?
cecill-b | cecill | cecill b{_OPT}
cecill-c | cecill | cecill c{_OPT}
cecill-2.1 | cecill | cecill {_V}2(?: [01])?
cecill | cecill | cecill{_OPT}
qpl-1.0 | qpl | (?:q public license|qpl)(?: {_V}1 0)?
apsl-2.0 | apsl apple | (?:apple public source license|apsl)(?: {_V}2(?: 0)?)?
nasa-1.3 | nasa | nasa open source agreement(?: {_V}1 3)?
rpl-1.5 | reciprocal | reciprocal public license(?: {_V}1 5)?
upl-1.0 | upl | (?:universal permissive license )?upl(?: {_V}1 0)?
blueoak-1.0.0 | blue | blue oak model license(?: 1 0 0)?
hippocratic-2.1 | hippocratic | hippocratic license(?: {_V}2 1)?
json | json | json {_LIC}
beerware | beerware beer | (?:the )?beer ?ware {_LIC}
polyform-noncommercial | polyform | polyform non ?commercial license(?: 1 0 0)?
polyform-shield | polyform | polyform shield license(?: 1 0 0)?
commons-clause | clause | commons clause(?: license condition)?
curl | curl | curl {_LIC}
bzip2 | bzip2 | (?:lib)?bzip2 {_LIC}
ijg | ijg jpeg | (?:ijg|independent jpeg group s?) ?{_LIC}
ftl | freetype | freetype(?: project)? {_LIC}
imagemagick | imagemagick | imagemagick {_LIC}
info-zip | zip | info zip {_LIC}
lppl-1.3c | lppl latex | (?:lppl|latex project public license)(?: {_V}1 3c?)?
mulanpsl-2.0 | mulan | mulan (?:permissive software license|psl)(?: {_V}2)?
oldap-2.8 | openldap | openldap public license(?: {_V}2 8)?
watcom-1.0 | watcom | (?:sybase )?open watcom public license(?: {_V}1 0)?
xfree86 | xfree86 | xfree86 {_LIC}(?: {_V}1 1)?
zpl-2.1 | zope zpl | (?:zope public license|zpl)(?: {_V}2 [01])?
cal-1.0 | cryptographic | cryptographic autonomy license(?: {_V}1 0)?
vsl-1.0 | vovida | vovida software license(?: {_V}1 0)?
ntp | ntp | ntp {_LIC}
public-domain | domain | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
proprietary | proprietary confidential | (?:proprietary and confidential|confidential and proprietary|proprietary licen[cs]e|commercial licen[cs]e agreement)
"""

#: label | keywords | sentence of a licence's text.
SENTENCES = f"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){{1,60}}?to whom the software is furnished to do so the software is provided
isc | hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
bsd-3-clause | endorse | neither the names? of (?:[^ ]+ ){{1,12}}?may be used to endorse or promote products derived from this software
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions | redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice this list of conditions and the following disclaimer
apache-2.0 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | grants | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache-2.0 | apache | https? www apache org licenses license 2 0(?: txt| html)?
apache-1.1 | apache | this product includes software developed by the apache (?:software foundation|group)
gpl-3.0 | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-2.0 | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-1.0 | redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1
gpl-2.0 | redistribute | redistribute it and or modify it under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation
lgpl-2.1 | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0 | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.0 | redistribute | redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2
agpl-3.0 | redistribute | redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
gpl | gnu | https? www gnu org (?:licenses|copyleft) gpl(?: html| txt| [23] 0(?: html| txt)?)?
lgpl | gnu | https? www gnu org (?:licenses|copyleft) (?:lgpl|lesser)(?: html| txt| [23] [01](?: html| txt)?)?
agpl-3.0 | gnu | https? www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gpl | everyone | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | inexpensively | the licen[cs]es for most software are designed to take away your freedom to share and change it
gfdl-1.3 | invariant | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla | https? (?:www )?mozilla org mpl 2 0
epl-2.0 | eclipse | made available under the terms of the eclipse public license (?:v )?2 0
epl-1.0 | eclipse | made available under the terms of the eclipse public license v1 0
cddl-1.0 | cddl | the contents of this file are subject to the terms of the common development and distribution license
cc0-1.0 | dedicated | (?:has|have) dedicated (?:all|the) (?:[^ ]+ ){{0,12}}?to the public domain (?:[^ ]+ ){{0,6}}?worldwide
cc0-1.0 | creativecommons | https? creativecommons org publicdomain zero 1 0
cc-by | creativecommons | https? creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons | https? creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons | https? creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons | https? creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons | https? creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | https? creativecommons org licenses by nc nd [1-4] [05]
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | boost | distributed under the boost software license version 1 0
bsl-1.0 | derivative | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
postgresql | hereby | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
eupl-1.2 | eupl | licensed under the eupl version 1 2 or as soon they will be approved by the european commission
json | evil | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
php-3.01 | php | this source file is subject to version 3 0?1 of the php license
sspl-1.0 | sspl | subject to the terms of the server side public license version 1
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | reserved | all rights reserved (?:no part of|unauthorized|this software is the confidential)
"""

#: Forms of rules: priority and confidence.
PRIORITY = {"tag": 4, "text": 3, "grant": 2, "name": 1}
CONFIDENCE = {"tag": 0.99, "text": 0.95, "grant": 0.9, "name": 0.7}
_GRANT = "(?:licen[cs]ed|released|distributed|redistributed|available|published|provided|covered|governed|offered|subject)"
_UNDER = "(?:under|by|to|with|as)"


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    keywords: tuple[str, ...]
    pattern: str

    @property
    def priority(self) -> int:
        return PRIORITY[self.form]


def _lines(table: str) -> list[tuple[str, tuple[str, ...], str]]:
    rows = [[part.strip() for part in line.split(" | ")] for line in table.strip().splitlines()]
    return [(label, tuple(keywords.split()), pattern) for label, keywords, pattern in rows]


def rules() -> list[Rule]:
    """All rules, first the ones that win ties."""
    licences = _lines(LICENCES)
    found = []
    for label, _, _ in licences:
        words = label.replace("-", " ").replace(".", " ")
        found.append(Rule(label, "tag", ("spdx",), f"spdx license identifier {words}(?: only| or later)?"))
    found += [Rule(label, "text", keywords, pattern) for label, keywords, pattern in _lines(SENTENCES)]
    for label, keywords, pattern in licences:
        granted = f"{_GRANT} (?:[^ ]+ ){{0,3}}?{_UNDER} (?:[^ ]+ ){{0,6}}?{pattern}"
        found.append(Rule(label, "grant", keywords, granted))
    found += [Rule(label, "name", keywords, pattern) for label, keywords, pattern in licences]
    return found
