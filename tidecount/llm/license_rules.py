"""The signature rules of the licence scan, written by hand: regular expressions over a text's lower-case words, joined by single spaces."""

from __future__ import annotations

# One rule a line: label, priority, confidence, keyword (a substring of every match), pattern. Priorities: 60 a licence with its version or
# exact variant, 50 the wording of a licence or its notice, 40 a licence by name, 30 by abbreviation, 20 in other languages, 10 and less vague hints.
RULES = r"""
gpl-1.0          60 0.95 gnu         | gnu (?:gpl|general public licen[sc]e)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?1(?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl-2.0          60 0.95 gnu         | gnu (?:gpl|general public licen[sc]e)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?2(?: 0)?(?: only| or (?:at your option )?(?:any )?later(?: version)?)?
gpl-3.0          60 0.95 gnu         | gnu (?:gpl|general public licen[sc]e)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?3(?: 0)?(?: only| or (?:at your option )?(?:any )?later(?: version)?)?
gpl-1.0          60 0.9  gpl         | gpl ?v?1(?: 0)?(?: only| or later)?
gpl-2.0          60 0.9  gpl         | gpl ?v?2(?: 0)?(?: only| or later)?
gpl-3.0          60 0.9  gpl         | gpl ?v?3(?: 0)?(?: only| or later)?
gpl-2.0          60 0.9  gpl         | gpl version 2(?: 0)?
gpl-3.0          60 0.9  gpl         | gpl version 3(?: 0)?
gpl              50 0.9  gnu         | you should have received a copy of the gnu general public licen[sc]e
gpl              50 0.8  free        | this program is free software you can redistribute it and or modify it under the terms of the gnu
gpl              40 0.8  gnu         | gnu (?:gpl|general public licen[sc]e)
gpl              30 0.7  gpl         | (?:the |a |under |sous |unter |bajo )gpl
gpl              30 0.7  gpl         | gpl licen[sc]ed?
gpl-classpath    60 0.95 gpl         | gpl ?v?2(?: 0)? with (?:the )?classpath exception
gpl-classpath    60 0.9  gnu         | gnu classpath exception
lgpl-2.0         60 0.95 gnu         | gnu (?:lgpl|(?:lesser|library) general public licen[sc]e)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?2(?: 0)?(?: only| or (?:at your option )?(?:any )?later(?: version)?)?
lgpl-2.1         60 0.95 gnu         | gnu (?:lgpl|(?:lesser|library) general public licen[sc]e)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?2 1(?: only| or (?:at your option )?(?:any )?later(?: version)?)?
lgpl-3.0         60 0.95 gnu         | gnu (?:lgpl|(?:lesser|library) general public licen[sc]e)(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?3(?: 0)?(?: only| or (?:at your option )?(?:any )?later(?: version)?)?
lgpl-2.0         60 0.9  lgpl        | lgpl ?(?:version |v)?2(?: 0)?(?: only| or later)?
lgpl-2.1         60 0.9  lgpl        | lgpl ?(?:version |v)?2 1(?: only| or later)?
lgpl-3.0         60 0.9  lgpl        | lgpl ?(?:version |v)?3(?: 0)?(?: only| or later)?
lgpl             40 0.8  gnu         | gnu (?:lgpl|(?:lesser|library) general public licen[sc]e)
lgpl             40 0.7  licen       | lesser general public licen[sc]e
lgpl             30 0.7  lgpl        | lgpl
agpl-1.0         60 0.9  affero      | affero general public licen[sc]e (?:version |v ?)?1(?: 0)?
agpl-3.0         60 0.95 affero      | (?:gnu )?affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?3(?: 0)?(?: only| or (?:at your option )?(?:any )?later(?: version)?)?
agpl-3.0         60 0.9  agpl        | agpl ?(?:version |v)?3(?: 0)?(?: only| or later)?
agpl             40 0.8  affero      | (?:gnu )?affero general public licen[sc]e
agpl             30 0.7  agpl        | agpl
gfdl-1.1         60 0.95 gnu         | gnu (?:fdl|free documentation licen[sc]e) (?:version |v ?)?1 1(?: or (?:any )?later(?: version)?)?
gfdl-1.2         60 0.95 gnu         | gnu (?:fdl|free documentation licen[sc]e) (?:version |v ?)?1 2(?: or (?:any )?later(?: version)?)?
gfdl-1.3         60 0.95 gnu         | gnu (?:fdl|free documentation licen[sc]e) (?:version |v ?)?1 3(?: or (?:any )?later(?: version)?)?
gfdl             40 0.8  gnu         | gnu (?:fdl|free documentation licen[sc]e)
gfdl             30 0.7  gfdl        | gfdl
gfdl             50 0.9  copy        | permission is granted to copy distribute and or modify this document under the terms of the gnu
apache-1.0       60 0.95 apache      | apache (?:software )?licen[sc]e (?:version |v ?)?1 0
apache-1.1       60 0.95 apache      | apache (?:software )?licen[sc]e (?:version |v ?)?1 1
apache-2.0       60 0.95 apache      | apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?
apache-2.0       60 0.95 apache      | (?:http|https) www apache org licenses license 2 0
apache-1.1       60 0.9  apache      | apache 1 1
apache-2.0       60 0.9  apache      | apache ?v?2(?: 0)?
apache-2.0       60 0.9  apache      | apache version 2(?: 0)?
apache-2.0       60 0.9  asl         | asl 2 0 licen[sc]e
apache           40 0.8  apache      | apache (?:software |public )?licen[sc]ed?
mit              50 1.0  hereby      | permission is hereby granted free of charge to any person obtaining a copy
mit              50 0.9  merchantab  | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0            60 0.95 licen       | mit no attribution(?: licen[sc]e)|licen[sc]e mit 0
mit              40 0.8  licen       | mit licen[sc]ed?
mit              40 0.8  licen       | (?:the )?mit x11 licen[sc]e|x11 mit licen[sc]e
mit              40 0.7  licen       | expat licen[sc]e
mit              30 0.7  licen       | licen[sc]ed? (?:under |is |type |as )?(?:the )?mit
x11              40 0.7  licen       | x11 licen[sc]e
bsd-1-clause     60 0.95 bsd         | bsd 1 clause|(?:1|one) clause bsd
bsd-2-clause     60 0.95 bsd         | bsd 2 clause|(?:2|two) clause bsd|simplified bsd(?: licen[sc]e)?|freebsd licen[sc]e
bsd-3-clause     60 0.95 bsd         | bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd(?: licen[sc]e)?
bsd-4-clause     60 0.95 bsd         | bsd 4 clause|(?:4|four) clause bsd|(?:original|old) bsd(?: licen[sc]e)?
bsd-0-clause     60 0.95 bsd         | 0bsd|bsd 0 clause|(?:0|zero) clause bsd
bsd              50 1.0  redistribut | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause     50 0.9  endorse     | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause     50 0.9  advertising | all advertising materials mentioning features or use of this software must display
bsd              40 0.8  bsd         | bsd(?: style| type| like)? licen[sc]ed?
bsd              30 0.6  bsd         | (?:under|sous|unter|bajo) (?:the |la |der )?bsd
isc              50 1.0  permission  | permission to use copy modify and or distribute this software for any purpose
isc              50 0.9  permission  | permission to use copy modify and distribute this software for any purpose
isc              40 0.8  licen       | isc licen[sc]ed?
isc              30 0.7  licen       | licen[sc]ed? (?:under |is |type )?(?:the )?isc
mpl-1.0          60 0.95 mozilla     | mozilla public licen[sc]e (?:version |v ?)?1 0
mpl-1.1          60 0.95 mozilla     | mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-2.0          60 0.95 mozilla     | mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
mpl-2.0          50 1.0  mozilla     | this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0
mpl-1.1          60 0.9  licen       | licen[sc]ed? (?:under |is |type )?(?:the )?mpl ?v?1 1
mpl-2.0          60 0.9  licen       | licen[sc]ed? (?:under |is |type )?(?:the )?mpl ?v?2(?: 0)?
mpl              40 0.8  mozilla     | mozilla public licen[sc]e
mpl              30 0.7  licen       | licen[sc]ed? (?:under |is |type )?(?:the )?mpl
epl-1.0          60 0.95 eclipse     | eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?
epl-2.0          60 0.95 eclipse     | eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
epl-2.0          60 0.9  licen       | licen[sc]ed? (?:under |is |type )?(?:the )?epl ?v?2(?: 0)?
epl              40 0.8  eclipse     | eclipse public licen[sc]e
edl              40 0.8  eclipse     | eclipse distribution licen[sc]e(?: 1 0| v 1 0| v1 0)?
eupl-1.1         60 0.95 licen       | european union public licen[sc]e (?:version |v ?)?1 1
eupl-1.2         60 0.95 licen       | european union public licen[sc]e (?:version |v ?)?1 2
eupl-1.1         60 0.9  eupl        | eupl ?v?1 1
eupl-1.2         60 0.9  eupl        | eupl ?v?1 2
eupl             40 0.8  licen       | european union public licen[sc]e
eupl             30 0.7  eupl        | eupl
cddl-1.0         60 0.95 licen       | common development and distribution licen[sc]e (?:version |v ?)?1 0
cddl-1.1         60 0.95 licen       | common development and distribution licen[sc]e (?:version |v ?)?1 1
cddl             40 0.8  licen       | common development and distribution licen[sc]e
cddl             30 0.7  cddl        | cddl(?: 1 [01])?
cpl-1.0          60 0.95 licen       | common public licen[sc]e (?:version |v ?)?1 0
cpl              40 0.8  licen       | common public licen[sc]e
cpal-1.0         60 0.95 licen       | common public attribution licen[sc]e(?: version| v)?(?: 1 0)?
ipl-1.0          60 0.95 licen       | ibm public licen[sc]e(?: version| v)?(?: 1 0)?
artistic-1.0     60 0.95 artistic    | artistic licen[sc]e (?:version |v ?)?1(?: 0)?
artistic-2.0     60 0.95 artistic    | artistic licen[sc]e (?:version |v ?)?2(?: 0)?
artistic         40 0.8  artistic    | artistic licen[sc]e
zlib             50 0.9  warranty    | this software is provided as is without any express or implied warranty in no event
zlib             40 0.8  zlib        | zlib (?:libpng )?licen[sc]e
libpng           40 0.8  libpng      | libpng licen[sc]e(?: version 2)?
boost-1.0        60 0.95 boost       | boost software licen[sc]e (?:version |v ?)?1 0
boost            40 0.8  boost       | boost software licen[sc]e
boost-1.0        60 0.9  licen       | licen[sc]ed? (?:under |is |type )?(?:the )?bsl 1 0
unlicense        50 1.0  unencumber  | this is free and unencumbered software released into the public domain
unlicense        40 0.8  unlicense   | (?:the |under |is )unlicense
wtfpl            40 0.9  public      | do what the fuck you want to public licen[sc]e(?: version 2)?
wtfpl            30 0.8  wtfpl       | wtfpl
beerware         50 0.9  beer        | (?:the )?beer ?ware licen[sc]e
python-2.0       60 0.95 python      | python software foundation licen[sc]e (?:version |v ?)?2(?: 0)?
python           40 0.8  python      | python software foundation licen[sc]e|python licen[sc]e|psf licen[sc]e agreement for python
ruby             40 0.8  ruby        | (?:the )?ruby(?: s)? licen[sc]e
php-3.0          60 0.95 php         | php licen[sc]e (?:version |v ?)?3 0
php-3.01         60 0.95 php         | php licen[sc]e (?:version |v ?)?3 01
php              40 0.8  php         | php licen[sc]e
openssl          40 0.8  openssl     | openssl licen[sc]e|openssl ssleay licen[sc]e
curl             40 0.8  curl        | curl licen[sc]e
ncsa             40 0.8  ncsa        | (?:university of illinois )?ncsa (?:open source )?licen[sc]e
icu              40 0.8  icu         | icu licen[sc]e
unicode          40 0.8  unicode     | unicode(?: inc)? licen[sc]e(?: agreement)?
w3c              40 0.8  w3c         | w3c (?:software (?:notice and )?)?(?:document )?licen[sc]e
postgresql       40 0.8  postgresql  | postgresql licen[sc]e
tcl              40 0.7  tcl         | tcl tk licen[sc]e|tcl licen[sc]e
vim              40 0.8  vim         | vim licen[sc]e
json             50 0.8  evil        | the software shall be used for good not evil
sleepycat        40 0.8  sleepycat   | sleepycat licen[sc]e
zope-2.1         60 0.95 zope        | zope public licen[sc]e(?: zpl)? (?:version |v ?)?2 1
zope             40 0.8  zope        | zope public licen[sc]e
lppl-1.3         60 0.95 latex       | latex project public licen[sc]e (?:version |v ?)?1 3[a-c]?
lppl             40 0.8  latex       | latex project public licen[sc]e
ofl-1.0          60 0.95 font        | sil open font licen[sc]e (?:version |v ?)?1 0
ofl-1.1          60 0.95 font        | sil open font licen[sc]e (?:version |v ?)?1 1
ofl              40 0.8  font        | (?:sil )?open font licen[sc]e
odbl-1.0         60 0.95 database    | open (?:data commons open )?database licen[sc]e (?:odbl )?(?:version |v ?)?1 0
odbl             40 0.8  database    | open (?:data commons open )?database licen[sc]e
odbl             30 0.7  odbl        | odbl(?: 1 0)?(?: licen[sc]e)
odc-by           40 0.8  attribution | open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?
pddl             40 0.8  dedication  | public domain dedication and licen[sc]e(?: pddl)?(?: version| v)?(?: 1 0)?
dbcl             40 0.8  database    | database contents licen[sc]e(?: 1 0)?
ms-pl            40 0.8  microsoft   | microsoft public licen[sc]e
ms-rl            40 0.8  microsoft   | microsoft reciprocal licen[sc]e
ms-pl            30 0.7  licen       | licen[sc]e ms pl
osl-2.1          60 0.95 licen       | open software licen[sc]e (?:version |v ?)?2 1
osl-3.0          60 0.95 licen       | open software licen[sc]e (?:version |v ?)?3 0
osl              40 0.7  licen       | open software licen[sc]e
afl-2.1          60 0.95 academic    | academic free licen[sc]e (?:version |v ?)?2 1
afl-3.0          60 0.95 academic    | academic free licen[sc]e (?:version |v ?)?3 0
afl              40 0.8  academic    | academic free licen[sc]e
ecl-2.0          60 0.95 educational | educational community licen[sc]e(?: version| v)?(?: 2 0)?
upl-1.0          60 0.95 universal   | universal permissive licen[sc]e(?: version| v)?(?: 1 0)?
rpl-1.5          60 0.95 reciprocal  | reciprocal public licen[sc]e(?: version| v)?(?: 1 5)?
qpl-1.0          60 0.95 licen       | q public licen[sc]e(?: version| v)?(?: 1 0)?
apsl-2.0         60 0.95 apple       | apple public source licen[sc]e(?: version| v)?(?: 2 0)?
nasa-1.3         60 0.95 nasa        | nasa open source agreement(?: version| v)?(?: 1 3)?(?: licen[sc]e)
cecill-2.1       60 0.95 cecill      | cecill (?:licen[sc]e )?(?:version |v ?)?2 1(?: licen[sc]e)
cecill           40 0.8  cecill      | cecill(?: b| c)? licen[sc]e|licen[sc]e cecill(?: b| c)?
mulan-2.0        60 0.95 mulan       | mulan (?:psl|permissive software licen[sc]e)(?: version| v ?)?(?: ?2)? licen[sc]e|mulan permissive software licen[sc]e(?: v ?2)?
vosl             40 0.7  vovida      | vovida software licen[sc]e
sspl-1.0         60 0.95 licen       | server side public licen[sc]e(?: version| v)?(?: 1)?
sspl             30 0.7  sspl        | sspl(?: 1 0| v1)?
busl-1.1         60 0.95 licen       | business source licen[sc]e(?: version| v)?(?: 1 1)?
busl             30 0.7  busl        | busl(?: 1 1)?
elastic-2.0      60 0.95 elastic     | elastic licen[sc]e(?: version| v)? ?2(?: 0)?
elastic          40 0.8  elastic     | elastic licen[sc]e
commons-clause   50 0.9  commons     | commons clause licen[sc]e condition|(?:the |with )commons clause
polyform         40 0.8  polyform    | polyform (?:noncommercial|small business|shield|strict|perimeter)(?: licen[sc]e)(?: 1 0 0)?
parity           40 0.8  parity      | parity public licen[sc]e
hippocratic      40 0.8  hippocratic | hippocratic licen[sc]e
ethical          40 0.6  ethical     | ethical source licen[sc]e
llama-2          60 0.95 llama       | llama 2 community licen[sc]e
llama-3          60 0.95 llama       | llama 3(?: [0-9])? community licen[sc]e
llama            40 0.8  llama       | llama community licen[sc]e
gemma            40 0.8  gemma       | gemma (?:terms of use|licen[sc]e)(?: licen[sc]e)?
bigscience-rail  60 0.95 rail        | bigscience (?:open ?)?rail(?: m)?(?: 1 0)? licen[sc]e|bigscience rail licen[sc]e(?: v ?1 0)?
openrail         40 0.9  openrail    | openrail(?: ?m| ?\+\+)?(?: licen[sc]e)?
openrail         40 0.9  licen       | open rail(?: m)? licen[sc]e|responsible ai licen[sc]e
creativeml       60 0.95 openrail    | creativeml openrail m
cdla-permissive  60 0.95 community   | community data licen[sc]e agreement permissive(?: version| v)?(?: [12] 0)?
cdla-sharing     60 0.95 community   | community data licen[sc]e agreement sharing(?: version| v)?(?: 1 0)?
ogl-uk           40 0.8  government  | open government licen[sc]e(?: version| v)?(?: ?[123](?: 0)?)?
etalab           40 0.8  ouverte     | licence ouverte(?: etalab)?(?: version)?(?: [12] 0)?
dl-de-by         40 0.8  datenlizenz | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
dl-de-zero       40 0.8  datenlizenz | datenlizenz deutschland zero(?: version)?(?: 2 0)?
cc0-1.0          60 0.95 cc          | cc ?0 1 0(?: universal)?
cc0-1.0          60 0.95 commons     | creative commons zero (?:version |v ?)?1 0
cc0              40 0.9  cc0         | cc0
cc0              40 0.9  cc          | cc (?:0|zero)
cc0              40 0.9  commons     | creative commons (?:cc0|zero|0)
cc-by-1.0        60 0.95 cc          | cc by 1 0
cc-by-2.0        60 0.95 cc          | cc by 2 0
cc-by-2.5        60 0.95 cc          | cc by 2 5
cc-by-3.0        60 0.95 cc          | cc by 3 0
cc-by-4.0        60 0.95 cc          | cc by 4 0
cc-by-4.0        60 0.95 cc          | cc attribution 4 0(?: international)?
cc-by-3.0        60 0.95 cc          | cc attribution 3 0(?: unported)?
cc-by-2.0        60 0.95 commons     | creative commons attribution 2 0(?: generic)?
cc-by-2.5        60 0.95 commons     | creative commons attribution 2 5(?: generic)?
cc-by-3.0        60 0.95 commons     | creative commons attribution 3 0(?: unported)?
cc-by-4.0        60 0.95 commons     | creative commons attribution 4 0(?: international)?
cc-by            40 0.9  commons     | creative commons attribution
cc-by            40 0.8  cc          | cc (?:by|attribution)
cc-by-sa-2.0     60 0.95 cc          | cc (?:by|attribution) (?:sa|share ?alike) 2 0
cc-by-sa-2.5     60 0.95 cc          | cc (?:by|attribution) (?:sa|share ?alike) 2 5
cc-by-sa-3.0     60 0.95 cc          | cc (?:by|attribution) (?:sa|share ?alike) 3 0
cc-by-sa-4.0     60 0.95 cc          | cc (?:by|attribution) (?:sa|share ?alike) 4 0
cc-by-sa-3.0     60 0.95 commons     | creative commons attribution (?:sa|share ?alike) 3 0(?: unported)?
cc-by-sa-4.0     60 0.95 commons     | creative commons attribution (?:sa|share ?alike) 4 0(?: international)?
cc-by-sa         40 0.9  commons     | creative commons attribution (?:sa|share ?alike)
cc-by-sa         40 0.9  cc          | cc (?:by|attribution) (?:sa|share ?alike)
cc-by-nc-3.0     60 0.95 cc          | cc (?:by|attribution) (?:nc|non ?commercial) 3 0
cc-by-nc-4.0     60 0.95 cc          | cc (?:by|attribution) (?:nc|non ?commercial) 4 0
cc-by-nc-4.0     60 0.95 commons     | creative commons attribution (?:nc|non ?commercial) 4 0(?: international)?
cc-by-nc         40 0.9  commons     | creative commons attribution (?:nc|non ?commercial)
cc-by-nc         40 0.9  cc          | cc (?:by|attribution) (?:nc|non ?commercial)
cc-by-nd-3.0     60 0.95 cc          | cc (?:by|attribution) (?:nd|no ?deriv(?:ative)?s?) 3 0
cc-by-nd-4.0     60 0.95 cc          | cc (?:by|attribution) (?:nd|no ?deriv(?:ative)?s?) 4 0
cc-by-nd-4.0     60 0.95 commons     | creative commons attribution (?:nd|no ?deriv(?:ative)?s?) 4 0(?: international)?
cc-by-nd         40 0.9  commons     | creative commons attribution (?:nd|no ?deriv(?:ative)?s?)
cc-by-nd         40 0.9  cc          | cc (?:by|attribution) (?:nd|no ?deriv(?:ative)?s?)
cc-by-nc-sa-3.0  60 0.95 cc          | cc (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike) 3 0
cc-by-nc-sa-4.0  60 0.95 cc          | cc (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike) 4 0
cc-by-nc-sa-4.0  60 0.95 commons     | creative commons attribution (?:nc|non ?commercial) (?:sa|share ?alike) 4 0(?: international)?
cc-by-nc-sa      40 0.9  commons     | creative commons attribution (?:nc|non ?commercial) (?:sa|share ?alike)
cc-by-nc-sa      40 0.9  cc          | cc (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)
cc-by-nc-nd-3.0  60 0.95 cc          | cc (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?) 3 0
cc-by-nc-nd-4.0  60 0.95 cc          | cc (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?) 4 0
cc-by-nc-nd-4.0  60 0.95 commons     | creative commons attribution (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?) 4 0(?: international)?
cc-by-nc-nd      40 0.9  commons     | creative commons attribution (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?)
cc-by-nc-nd      40 0.9  cc          | cc (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?)
cc               10 0.6  commons     | creative commons(?: licen[sc]e| licensed)?
public-domain    50 0.9  domain      | (?:released|dedicated|placed|put) (?:in|into|to) the (?:worldwide )?public domain
public-domain    40 0.7  domain      | (?:is|are) (?:in|part of) the public domain
public-domain    40 0.8  domain      | public domain mark(?: 1 0)?
public-domain    20 0.6  domain      | (?:dans le )?domaine public
public-domain    20 0.6  dominio     | (?:en el |de )?dominio p[uú]blico
public-domain    20 0.6  gemeinfrei  | gemeinfrei(?:e|es|er)?
proprietary      50 0.8  proprietary | proprietary and confidential
proprietary      50 0.8  copying     | unauthorized (?:copying|reproduction or copying)
proprietary      50 0.8  reproduced  | no part of this (?:publication|book|document|work) may be reproduced
proprietary      40 0.7  licen       | end user licen[sc]e agreement|software licen[sc]e agreement
proprietary      40 0.7  proprietary | (?:is|under a|this) proprietary licen[sc]e
proprietary      10 0.5  reserved    | all rights reserved
proprietary      10 0.5  droits      | tous droits r[eé]serv[eé]s
proprietary      10 0.5  reserv      | todos los derechos reservados
proprietary      10 0.5  vorbehalten | alle rechte vorbehalten
copyleft         10 0.4  copyleft    | copyleft
spdx             10 0.6  spdx        | spdx license identifier
unknown          5  0.4  licen       | (?:is|are|be) licen[sc]ed under
unknown          5  0.4  licence     | sous (?:la )?licence
unknown          5  0.4  licencia    | bajo (?:la |una )?licencia
unknown          5  0.4  lizenz      | unter (?:der |einer )?lizenz
copyright        5  0.3  copyright   | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright        5  0.2  copyright   | copyright (?:c )?(?:by )?the
"""


def parsed() -> list[tuple[str, int, float, str, str]]:
    """The rules in order: label, priority, confidence, keyword, pattern."""
    out = []
    for line in RULES.strip().split("\n"):
        head, _, pattern = line.partition(" | ")
        label, priority, confidence, key = head.split()
        out.append((label, int(priority), float(confidence), key, pattern))
    return out
