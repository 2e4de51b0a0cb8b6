"""The ordered signature rules of the license scan.

A line of LICENSES is one license: label | identifiers | titles | names | links | texts, each part a list parted
by ``;``. Patterns are written over normalised text: lower-case words with one space
between. ``license`` also stands for ``licence``; ``{2.0}`` for a version as it is written (2, 2.0, v2, version 2.0 ...).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Kinds of rules in order of priority, with the weight of a match.
KINDS = {"text": 0.98, "identifier": 0.97, "notice": 0.95, "link": 0.9, "title": 0.8, "name": 0.5}

#: What stands before a title where something is put under it.
GRANT = "(?:(?:re|dual |also )?licensed|(?:re)?distributed|(?:re)?released|available|provided|published|offered|covered|made available|shared)(?: [^ ]+){0,3}? (?:under|by|with|pursuant to)(?: the| a| an)?(?: terms| terms and conditions| conditions)?(?: of| in)?(?: the| a| an)? "

#: What follows a version where later ones are allowed too.
LATER = "(?: of the license)?(?: only)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"

LICENSES = """
mit | mit | mit license; expat license; mit expat license; x11 style mit license | mit licensed; license mit; licensed mit | opensource org licenses? mit; mit license org; choosealicense com licenses mit; spdx org licenses mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | mit 0 | mit no attribution(?: license)?; mit zero license | mit 0 licensed | github com aws mit 0; opensource org licenses? mit 0 |
x11 | x11 | x11 license; mit x11 license; x consortium license | | | except as contained in this notice the name of the x consortium shall not be used
apache-1 | apache 1 0 | apache software license{1.0}; apache license{1.0} | | apache org licenses license 1 0 | this product includes software developed by the apache group for use in the apache http server project
apache-1.1 | apache 1 1 | apache software license{1.1}; apache license{1.1} | apache{1.1} | apache org licenses license 1 1; opensource org licenses? apache 1 1 | this product includes software developed by the apache software foundation
apache-2 | apache 2 0 | apache license{2.0}; apache software license{2.0}; apache public license{2.0} | asl{2.0}; apache{2.0}; apachev2; license apache | apache org licenses license 2 0; opensource org licenses? apache 2 0; choosealicense com licenses apache 2 0 | you may not use this file except in compliance with the license you may obtain a copy of the license at; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache | | apache license; apache software license | apache licensed | apache org licenses |
0bsd | 0bsd | zero clause bsd license; bsd zero clause license; free public license{1.0.0} | 0bsd | opensource org licenses? 0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-1-clause | bsd 1 clause | bsd 1 clause license; (?:one|1) clause bsd license | | opensource org licenses? bsd 1 clause |
bsd-2-clause | bsd 2 clause; bsd 2 clause freebsd; bsd 2 clause netbsd | bsd 2 clause(?: simplified)? license; (?:two|2) clause bsd license; simplified bsd license; freebsd license; free bsd license; netbsd license | bsd 2 clause; (?:two|2) clause bsd | opensource org licenses? bsd 2 clause; freebsd org copyright freebsd license |
bsd-2-clause-patent | bsd 2 clause patent | bsd 2 clause plus patent license; bsd plus patent license; bsd patent license | | opensource org licenses? bsdpluspatent |
bsd-3-clause | bsd 3 clause; bsd new | bsd 3 clause(?: new| revised)?(?: or revised)? license; (?:three|3) clause bsd license; new bsd license; revised bsd license; modified bsd license | bsd 3 clause; (?:three|3) clause bsd | opensource org licenses? bsd 3 clause; opensource org licenses? bsd license | neither the names? of .{1,80}? nor the names of (?:its|any) contributors may be used to endorse or promote products derived from this software
bsd-3-clause-clear | bsd 3 clause clear | clear bsd license; bsd 3 clause clear license | | | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | bsd 4 clause; bsd 4 clause uc | bsd 4 clause(?: original)?(?: or old)? license; (?:four|4) clause bsd license; original bsd license; old bsd license | bsd 4 clause; (?:four|4) clause bsd | | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | | bsd license; bsd style license; berkeley software distribution license | bsd licensed; license bsd | opensource org licenses? bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
isc | isc | isc license; internet systems consortium license; internet software consortium license | isc licensed; license isc | opensource org licenses? isc; isc org licenses | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
gpl-1.0 | gpl 1 0; gpl 1 0 only | gnu general public license{1.0}; general public license{1.0} | gpl{1.0} | gnu org licenses(?: old licenses)? gpl 1 0 |
gpl-2.0 | gpl 2 0; gpl 2 0 only | gnu general public license{2.0}; general public license{2.0}; gnu gpl{2.0}; gnu general public license as published by the free software foundation(?: either)?{2.0} | gpl{2.0}; license gpl2 | gnu org licenses(?: old licenses)? gpl 2 0; opensource org licenses? gpl 2 0 | gnu general public license version 2 june 1991
gpl-3.0 | gpl 3 0; gpl 3 0 only | gnu general public license{3.0}; general public license{3.0}; gnu gpl{3.0}; gnu general public license as published by the free software foundation(?: either)?{3.0} | gpl{3.0}; license gpl3 | gnu org licenses gpl 3 0; opensource org licenses? gpl 3 0 | gnu general public license version 3 29 june 2007
gpl-2.0-or-later | gpl 2 0 or later; gpl 2 0 plus | gnu general public license{2.0}+; gnu general public license as published by the free software foundation(?: either)?{2.0}+; gnu gpl{2.0}+ | gpl{2.0}+ | |
gpl-3.0-or-later | gpl 3 0 or later; gpl 3 0 plus | gnu general public license{3.0}+; gnu general public license as published by the free software foundation(?: either)?{3.0}+; gnu gpl{3.0}+ | gpl{3.0}+ | |
gpl | gpl | gnu general public license; gnu gpl license; gnu public license | gnu gpl; gpl licensed; gpled; license gpl | gnu org licenses gpl; gnu org copyleft gpl | you should have received a copy of the gnu general public license along with this program
gpl-2.0-with-classpath-exception | gpl 2 0 with classpath exception | gnu general public license{2.0} with(?: the)? classpath exception | gpl{2.0} with(?: the)? classpath exception | openjdk (?:java net|org) legal gplv2 ce | designates this particular file as subject to the classpath exception
gcc-exception-3.1 | gcc exception 3 1 | gcc runtime library exception(?:{3.1})? | | gnu org licenses gcc exception |
lgpl-2.0 | lgpl 2 0; lgpl 2 0 only | gnu library general public license(?:{2.0})?; library general public license{2.0} | | gnu org licenses old licenses lgpl 2 0 | you should have received a copy of the gnu library general public license
lgpl-2.1 | lgpl 2 1; lgpl 2 1 only | gnu lesser general public license{2.1}; lesser general public license{2.1}; gnu lgpl{2.1}; gnu lesser general public license as published by the free software foundation(?: either)?{2.1} | lgpl{2.1} | gnu org licenses(?: old licenses)? lgpl 2 1; opensource org licenses? lgpl 2 1 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | lgpl 3 0; lgpl 3 0 only | gnu lesser general public license{3.0}; lesser general public license{3.0}; gnu lgpl{3.0}; gnu lesser general public license as published by the free software foundation(?: either)?{3.0} | lgpl{3.0} | gnu org licenses lgpl 3 0; opensource org licenses? lgpl 3 0 |
lgpl-2.1-or-later | lgpl 2 1 or later; lgpl 2 1 plus | gnu lesser general public license{2.1}+; gnu lesser general public license as published by the free software foundation(?: either)?{2.1}+ | lgpl{2.1}+ | |
lgpl-3.0-or-later | lgpl 3 0 or later; lgpl 3 0 plus | gnu lesser general public license{3.0}+; gnu lesser general public license as published by the free software foundation(?: either)?{3.0}+ | lgpl{3.0}+ | |
lgpl | lgpl | gnu lesser general public license; lesser gnu public license | gnu lgpl; lgpl licensed; license lgpl | gnu org licenses lgpl; gnu org copyleft lesser | you should have received a copy of the gnu lesser general public license
agpl-1.0 | agpl 1 0 | affero general public license{1.0} | agpl{1.0} | affero org oagpl |
agpl-3.0 | agpl 3 0; agpl 3 0 only | gnu affero general public license{3.0}; affero general public license{3.0}; gnu agpl{3.0}; gnu affero general public license as published by the free software foundation(?: either)?{3.0} | agpl{3.0} | gnu org licenses agpl 3 0; opensource org licenses? agpl (?:v3|3 0) |
agpl-3.0-or-later | agpl 3 0 or later; agpl 3 0 plus | gnu affero general public license{3.0}+; gnu affero general public license as published by the free software foundation(?: either)?{3.0}+ | agpl{3.0}+ | |
agpl | agpl | gnu affero general public license; affero general public license | gnu agpl; agpl licensed; license agpl | gnu org licenses agpl | you should have received a copy of the gnu affero general public license
gfdl-1.1 | gfdl 1 1 | gnu free documentation license{1.1} | gfdl{1.1} | gnu org licenses(?: old licenses)? fdl 1 1 |
gfdl-1.2 | gfdl 1 2 | gnu free documentation license{1.2} | gfdl{1.2} | gnu org licenses(?: old licenses)? fdl 1 2 |
gfdl-1.3 | gfdl 1 3 | gnu free documentation license{1.3} | gfdl{1.3} | gnu org licenses fdl 1 3 |
gfdl | gfdl | gnu free documentation license | gnu fdl; gfdl | gnu org copyleft fdl | with no invariant sections no front cover texts and no back cover texts
mpl-1.0 | mpl 1 0 | mozilla public license{1.0} | mpl{1.0} | mozilla org mpl 1 0 |
mpl-1.1 | mpl 1 1 | mozilla public license{1.1} | mpl{1.1} | mozilla org mpl 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mpl 2 0 | mozilla public license{2.0} | mpl{2.0} | mozilla org mpl 2 0; opensource org licenses? mpl 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl | mpl | mozilla public license | mpl licensed | mozilla org mpl |
epl-1.0 | epl 1 0 | eclipse public license{1.0} | epl{1.0} | eclipse org legal epl v10; eclipse org org documents epl v10; opensource org licenses? epl 1 0 | the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | epl 2 0 | eclipse public license{2.0} | epl{2.0} | eclipse org legal epl (?:2 0|v20); opensource org licenses? epl 2 0 |
epl | epl | eclipse public license | epl licensed | eclipse org legal epl |
edl-1.0 | edl 1 0 | eclipse distribution license{1.0} | edl{1.0} | eclipse org org documents edl v10 |
cpl-1.0 | cpl 1 0 | common public license{1.0}; ibm common public license | cpl{1.0} | opensource org licenses? cpl1 0 |
ipl-1.0 | ipl 1 0 | ibm public license{1.0} | | opensource org licenses? ibmpl |
cddl-1.0 | cddl 1 0 | common development and distribution license{1.0} | cddl{1.0} | opensource org licenses? cddl 1 0; opensolaris org os licensing |
cddl-1.1 | cddl 1 1 | common development and distribution license{1.1} | cddl{1.1} | |
cddl | cddl | common development and distribution license | cddl licensed | sun com cddl |
cpal-1.0 | cpal 1 0 | common public attribution license(?:{1.0})? | cpal{1.0} | opensource org licenses? cpal 1 0 |
eupl-1.1 | eupl 1 1 | european union public licen[cs]e{1.1} | eupl{1.1} | |
eupl-1.2 | eupl 1 2 | european union public licen[cs]e{1.2} | eupl{1.2} | joinup ec europa eu .{0,60}?eupl; opensource org licenses? eupl 1 2 |
eupl | eupl | european union public license; licence publique de l union europ.{1,2}enne | eupl licensed | |
bsl-1.0 | bsl 1 0 | boost software license{1.0}; boost software license | boost licensed | boost org license 1 0; opensource org licenses? bsl 1 0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
busl-1.1 | busl 1 1 | business source license(?:{1.1})? | busl{1.1} | mariadb com bsl11 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
sspl-1.0 | sspl 1 0 | server side public license(?:{1.0})? | sspl{1.0}; sspl licensed | mongodb com licensing server side public license |
elastic-2.0 | elastic 2 0 | elastic license{2.0}; elastic license | | elastic co licensing elastic license |
commons-clause | | commons clause license condition; commons clause(?:{1.0})? | | commonsclause com | the license does not grant to you the right to sell the software
polyform-noncommercial-1.0.0 | polyform noncommercial 1 0 0 | polyform noncommercial license(?:{1.0.0})? | | polyformproject org licenses noncommercial |
polyform-small-business-1.0.0 | polyform small business 1 0 0 | polyform small business license(?:{1.0.0})? | | polyformproject org licenses small business |
confluent-community-1.0 | | confluent community license(?:{1.0})? | | confluent io confluent community license |
redis-source-available | | redis source available license(?:{2.0})?; redis source available license{1.0} | rsalv2 | redis com legal rsalv2 agreement |
unlicense | unlicense | the unlicense; unlicense license | unlicensed into the public domain | unlicense org; choosealicense com licenses unlicense | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | do what the f.{1,4}k you want to public license; do what the f.{1,4} you want to public license | wtfpl | wtfpl net; sam zoy org wtfpl | you just do what the f.{1,4} you want to
cc0-1.0 | cc0 1 0 | cc0 1 0 universal; creative commons zero(?:{1.0})?; creative commons cc0(?: license)? | cc0(?: 1 0)?(?: licensed| license)? | creativecommons org publicdomain zero 1 0 | to the extent possible under law the .{1,80}? has waived all copyright and related or neighboring rights
cc-pddc | cc pddc | creative commons public domain dedication(?: and certification)? | | creativecommons org licenses publicdomain |
public-domain | | public domain dedication | dedicated to the public domain; placed in the public domain; released into the public domain; put in the public domain; public domain software | creativecommons org publicdomain mark 1 0 |
odbl-1.0 | odbl 1 0 | open database license(?:{1.0})?; open data commons open database license(?:{1.0})? | odbl(?:{1.0})? | opendatacommons org licenses odbl |
odc-by-1.0 | odc by 1 0 | open data commons attribution license(?:{1.0})? | odc by(?:{1.0})? | opendatacommons org licenses by |
pddl-1.0 | pddl 1 0 | open data commons public domain dedication(?: and| &)? license(?:{1.0})? | pddl(?:{1.0})? | opendatacommons org licenses pddl |
dbcl-1.0 | | database contents license(?:{1.0})? | dbcl(?:{1.0})? | opendatacommons org licenses dbcl |
ogl-uk-1.0 | ogl uk 1 0 | open government licen[cs]e{1.0} | | nationalarchives gov uk doc open government licen[cs]e version 1 |
ogl-uk-2.0 | ogl uk 2 0 | open government licen[cs]e{2.0} | | nationalarchives gov uk doc open government licen[cs]e version 2 |
ogl-uk-3.0 | ogl uk 3 0 | open government licen[cs]e{3.0} | | nationalarchives gov uk doc open government licen[cs]e version 3 |
ogl-uk | | open government license | | nationalarchives gov uk doc open government licen[cs]e |
etalab-2.0 | etalab 2 0 | licence ouverte{2.0}; etalab open license{2.0} | | etalab gouv fr licence ouverte |
dl-de-by-2.0 | dl de by 2 0 | datenlizenz deutschland namensnennung{2.0} | dl de by{2.0} | govdata de dl de by 2 0 |
artistic-1.0 | artistic 1 0; artistic 1 0 perl | artistic license{1.0}; perl artistic license | artistic{1.0} | opensource org licenses? artistic license 1 0 | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | artistic 2 0 | artistic license{2.0} | artistic{2.0} | opensource org licenses? artistic license 2 0; perlfoundation org artistic license 2 0 | this license establishes the terms under which a given free software package may be copied modified distributed
artistic | | artistic license; clarified artistic license | | opensource org licenses? artistic license |
perl | | same terms as perl(?: itself)?; same terms as the perl ?5? programming language | | dev perl org licenses |
psf-2.0 | psf 2 0; python 2 0 | python software foundation license(?:{2.0})?; psf license(?: agreement)?(?:{2.0})?; python license{2.0} | psf{2.0} | python org psf license; docs python org 3 license | psf is making python available to licensee on an as is basis
cnri-python | cnri python | cnri python license; cnri open source gpl compatible license agreement | | handle net python licenses | 
zpl-2.0 | zpl 2 0 | zope public license{2.0} | zpl{2.0} | |
zpl-2.1 | zpl 2 1 | zope public license{2.1} | zpl{2.1} | opensource org licenses? zpl 2 1 |
zpl | | zope public license | | zope org resources zpl |
ruby | ruby | ruby license; ruby s license; same terms as ruby(?: itself)? | | ruby lang org en about license |
php-3.0 | php 3 0 | php license{3.0} | | php net license 3 0 | this product includes php software freely available from
php-3.01 | php 3 01 | php license{3.01} | | php net license 3 01 |
openssl | openssl | openssl license; openssl and ssleay license | | openssl org source license | this product includes software developed by the openssl project for use in the openssl toolkit; this product includes cryptographic software written by eric young
zlib | zlib | zlib license; zlib libpng license; zlib png license | zlib licensed | opensource org licenses? zlib; zlib net zlib license; gzip org zlib zlib license | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
libpng-2.0 | libpng 2 0 | libpng license{2.0}; png reference library license version 2; libpng license | | libpng org pub png src libpng license |
ijg | ijg | independent jpeg group(?: s)? license | | | this software is based in part on the work of the independent jpeg group
ftl | ftl | freetype license; freetype project license | | freetype org license | portions of this software are copyright .{1,40}? the freetype project
curl | curl | curl license | | curl (?:se|haxx se) docs copyright |
icu | icu | icu license; icu 1 8 1 and later license | | source icu project org repos icu | 
unicode-dfs-2016 | unicode dfs 2016; unicode dfs 2015; unicode 3 0 | unicode license agreement data files and software; unicode license v3; unicode license agreement | | unicode org copyright; unicode org license |
ncsa | ncsa | university of illinois ncsa open source license; university of illinois open source license; ncsa open source license | | opensource org licenses? ncsa; otm illinois edu uiuc opensource | neither the names of .{1,100}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
llvm-exception | llvm exception; apache 2 0 with llvm exception | apache license{2.0} with llvm exceptions?; apache 2 0 license with llvm exceptions? | | llvm org license | as an exception if as a result of your compiling your source code portions of this software are embedded
ms-pl | ms pl | microsoft public license | ms pl | opensource org licenses? ms pl; microsoft com opensource licenses |
ms-rl | ms rl | microsoft reciprocal license | ms rl | opensource org licenses? ms rl |
osl-1.0 | osl 1 0 | open software license{1.0} | osl{1.0} | |
osl-2.1 | osl 2 1 | open software license{2.1} | osl{2.1} | |
osl-3.0 | osl 3 0 | open software license{3.0} | osl{3.0} | opensource org licenses? osl 3 0 | licensed under the open software license version 3 0
afl-2.1 | afl 2 1 | academic free license{2.1} | afl{2.1} | |
afl-3.0 | afl 3 0 | academic free license{3.0} | afl{3.0} | opensource org licenses? afl 3 0 | licensed under the academic free license version 3 0
ecl-1.0 | ecl 1 0 | educational community license{1.0} | ecl{1.0} | |
ecl-2.0 | ecl 2 0 | educational community license{2.0} | ecl{2.0} | opensource org licenses? ecl 2 0 |
apsl-1.0 | apsl 1 0 | apple public source license{1.0} | apsl{1.0} | |
apsl-2.0 | apsl 2 0 | apple public source license{2.0} | apsl{2.0} | opensource apple com license apsl; opensource org licenses? apsl 2 0 |
lppl-1.0 | lppl 1 0 | latex project public license{1.0} | lppl{1.0} | |
lppl-1.3c | lppl 1 3a; lppl 1 3c | latex project public license{1.3}[ac]?; latex project public license | lppl{1.3}[ac]? | latex project org lppl |
ofl-1.0 | ofl 1 0 | sil open font license{1.0} | | |
ofl-1.1 | ofl 1 1 | sil open font license{1.1}; sil open font license; open font license{1.1} | ofl{1.1} | scripts sil org ofl; openfontlicense org; opensource org licenses? ofl 1 1 | this font software is licensed under the sil open font license
bitstream-vera | bitstream vera | bitstream vera fonts? (?:copyright|license) | | | bitstream vera is a trademark of bitstream
ubuntu-font-1.0 | ubuntu font 1 0 | ubuntu font licen[cs]e(?:{1.0})? | | font ubuntu com licen[cs]e |
ncgl-uk-2.0 | ncgl uk 2 0 | non commercial government licen[cs]e(?:{2.0})? | | |
cecill-1.0 | cecill 1 0 | cecill(?: free software)? license(?: agreement)?{1.0} | cecill{1.0} | |
cecill-2.0 | cecill 2 0 | cecill(?: free software)? license(?: agreement)?{2.0} | cecill{2.0} | cecill info licences licence cecill v2 |
cecill-2.1 | cecill 2 1 | cecill(?: free software)? license(?: agreement)?{2.1} | cecill{2.1} | opensource org licenses? cecill 2 1 |
cecill-b | cecill b | cecill b(?: free software)? license(?: agreement)? | | cecill info licences licence cecill b |
cecill-c | cecill c | cecill c(?: free software)? license(?: agreement)? | | cecill info licences licence cecill c |
mulanpsl-1.0 | mulanpsl 1 0 | mulan permissive software license{1.0}; mulan psl{1.0} | mulanpsl{1.0} | |
mulanpsl-2.0 | mulanpsl 2 0 | mulan permissive software license{2.0}; mulan psl{2.0} | mulanpsl{2.0} | license coscl org cn mulanpsl2 |
upl-1.0 | upl 1 0 | universal permissive license(?:{1.0})? | upl{1.0} | oss oracle com licenses upl | the universal permissive license upl version 1 0
bcl-oracle | | oracle binary code license agreement; sun binary code license agreement; oracle technology network license agreement | | |
postgresql | postgresql | postgresql license; postgresql licence | | opensource org licenses? postgresql; postgresql org about licence | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
w3c | w3c; w3c 20150513 | w3c software(?: and document)? notice and license; w3c software license; w3c document license | | w3 org consortium legal |
ntp | ntp | ntp license; historical permission notice and disclaimer | hpnd | opensource org licenses? ntp |
beerware | beerware | beer ?ware license; the beer ware license | beerware | | as long as you retain this notice you can do whatever you want with this stuff if we meet some day
json | json | json license; json org license | | json org license | the software shall be used for good not evil
vim | vim | vim license | | vimdoc sourceforge net htmldoc uganda |
sleepycat | sleepycat | sleepycat(?: public| software product)? license | | opensource org licenses? sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code
qpl-1.0 | qpl 1 0 | q public license(?:{1.0})? | qpl{1.0} | opensource org licenses? qpl 1 0; trolltech com products qt licenses |
rpl-1.5 | rpl 1 5; rpl 1 1 | reciprocal public license(?:{1.5})? | | opensource org licenses? rpl 1 5 |
npl-1.1 | npl 1 1; npl 1 0 | netscape public license(?:{1.1})?; netscape public license{1.0} | | mozilla org mpl npl 1 1 |
spl-1.0 | spl 1 0 | sun public license(?:{1.0})? | | opensource org licenses? sunpublic |
watcom-1.0 | watcom 1 0 | sybase open watcom public license(?:{1.0})? | | opensource org licenses? watcom |
intel-simplified | intel acpi | intel simplified software license; intel open source license | | software intel com .{0,40}?simplified software license |
nasa-1.3 | nasa 1 3 | nasa open source agreement(?:{1.3})? | | opensource org licenses? nasa1 3 |
openldap-2.8 | oldap 2 8 | openldap public license(?:{2.8})? | | openldap org software release license |
tcl | tcl | tcl tk license; tcl license | | tcl tk? software license terms |
blueoak-1.0.0 | blueoak 1 0 0 | blue oak model license(?:{1.0.0})? | | blueoakcouncil org license 1 0 0 |
hippocratic-2.1 | hippocratic 2 1 | hippocratic license(?:{2.1})?; hippocratic license{3.0} | | firstdonoharm dev |
openrail | | creativeml open ?rail m license; bigscience (?:open ?)?rail(?: m)? license(?:{1.0})?; bigcode open ?rail m license | open ?rail m; open ?rail license | huggingface co spaces bigscience license |
llama-community | | llama [234](?: [0-9])? community license(?: agreement)?; meta llama community license | | ai meta com llama license; llama meta com license |
gemma | | gemma terms of use | | ai google dev gemma terms |
deepseek | | deepseek (?:model )?license(?: agreement)? | | github com deepseek ai .{0,60}?license model |
cc-sampling | | creative commons sampling plus license(?:{1.0})? | | creativecommons org licenses sampling |
ccby-devnations | | creative commons developing nations license | | creativecommons org licenses devnations |
creative-commons | | creative commons license; creative commons licence | licensed under creative commons | creativecommons org licenses |
all-rights-reserved | | | all rights reserved; tous droits r.{1,2}serv.{1,2}s; alle rechte vorbehalten; todos los derechos reservados | |
proprietary | | proprietary license; commercial license agreement; end user license agreement | proprietary and confidential; confidential and proprietary; unauthorized copying of this file via any medium is strictly prohibited | | this software is the confidential and proprietary information of
non-commercial | | | for non commercial use only; non commercial use only; not for commercial use; for personal use only; for academic use only; for research purposes only; for evaluation purposes only | |
freeware | | freeware license | distributed as freeware; freeware for personal use; this software is freeware | |
shareware | | shareware license | distributed as shareware; this software is shareware | |
see-license-file | | | see (?:the )?license(?: md| txt)? (?:file )?for (?:more )?(?:details|information|the full license); license that can be found in the license file | |
""".strip("\n")

#: Creative Commons: the elements of each license, and the versions; their rules are made from them.
ELEMENTS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s(?: works)?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


@dataclass(frozen=True)
class Rule:
    """A signature: every match, with the space before it, holds ``keyword``; ``rank`` is its priority (smaller first)."""

    label: str
    kind: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    rank: int


def _version(found: re.Match) -> str:
    """A version as it is written: ``2.0`` also as 2, and no other digit behind it."""
    major, *minor = found[1].split(".")
    rest = "(?: 0)*" if set(minor) <= {"0"} else "".join(" " + m for m in minor)
    return f"(?: version| ver| v)? ?v?{major}{rest}(?! [0-9](?![^ ]))"


def written(pattern: str) -> str:
    """The regular expression that a pattern of the table stands for."""
    later = pattern.endswith("+")
    out = re.sub(r"\{([0-9.]+)\}", _version, pattern.removesuffix("+")) + LATER * later
    return re.sub(r"\blicense", "licen[cs]e", out)


def keyword(regex: str) -> str:
    """The longest literal that every match must hold: outside groups and classes, and not before a quantifier."""
    plain, depth, i = "", 0, 0
    while i < len(regex):
        c = regex[i]
        if c == "[" and depth == 0:
            i = regex.index("]", i)
            plain += "\0"
        elif c == "(":
            depth += 1
            plain += "\0"
        elif c == ")":
            depth -= 1
        elif depth == 0:
            if c in "?*{":
                plain = plain[:-1] + "\0"
                i = regex.index("}", i) if c == "{" else i
            else:
                plain += "\0" if c in ".+|" else c
        i += 1
    return max(plain.split("\0"), key=lambda x: len(x.replace(" ", "")))


def _parts(line: str) -> list[str]:
    """The six parts of a line; a bar between spaces parts them, one inside a group is the pattern's own."""
    found = re.split(r" \|(?=\s|$)", line)
    return found + [""] * (6 - len(found))


def rules() -> list[Rule]:
    """All rules in order of priority: by kind, then as they stand in the table."""
    made: list[tuple[str, str, str]] = []
    for line in LICENSES.split("\n"):
        label, ids, titles, names, links, texts = ([x.strip() for x in part.split(";") if x.strip()] for part in _parts(line))
        made += [(label[0], "identifier", f"(?:spdx )?license identifiers? {x}") for x in ids]
        made += [(label[0], "notice", GRANT + x) for x in titles]
        made += [(label[0], kind, x) for kind, some in (("title", titles), ("name", names), ("link", links), ("text", texts)) for x in some]
    for short, long in ELEMENTS.items():
        label = "cc-" + short.replace(" ", "-")
        for v in VERSIONS:
            made += [(f"{label}-{v}", "title", f"creative commons {long}(?: license)?(?: international| unported)?{{{v}}}(?: international| unported| generic)?(?: license)?"), (f"{label}-{v}", "name", f"cc {short}{{{v}}}")]
            made += [(f"{label}-{v}", "notice", GRANT + f"creative commons {long}(?: license)?{{{v}}}"), (f"{label}-{v}", "notice", GRANT + f"cc {short}{{{v}}}"), (f"{label}-{v}", "identifier", f"(?:spdx )?license identifiers? cc {short} {v.replace('.', ' ')}"), (f"{label}-{v}", "link", f"creativecommons org licenses {short} {v.replace('.', ' ')}")]
        made += [(label, "title", f"creative commons {long}(?: license)?"), (label, "name", f"cc {short}(?: licensed| license)?"), (label, "link", f"creativecommons org licenses {short}")]
    order = list(KINDS)
    made.sort(key=lambda r: order.index(r[1]))
    out = []
    for rank, (label, kind, pattern) in enumerate(made):
        regex = written(pattern)
        held = keyword(regex)
        out.append(Rule(label, kind, (" " * regex.startswith(held) + held).encode(), re.compile(rb"(?<![^ ])(?:" + regex.encode() + rb")(?![^ ])"), rank))
    return out
