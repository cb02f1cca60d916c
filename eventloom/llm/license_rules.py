"""Signature rules of licences, written by hand, in order: of two equal finds the earlier rule stays.

A rule is `label; keywords; pattern`. Patterns are matched on a text's words (lower-cased A-Z, digits and
non-ASCII characters) joined by one space, from word start to word end. All keywords must occur in the text
as words before the pattern is tried. <v> stands for an optional "version", "ver" or "v"; <l> for both spellings of licence.
A section has a priority (1 goes first) and the confidence of its finds.
"""

from __future__ import annotations

#: section: (priority, confidence)
SECTIONS = {"notice": (1, 0.98), "title": (2, 0.95), "identifier": (3, 0.95), "address": (3, 0.9), "name": (4, 0.8), "hint": (5, 0.4)}

NOTICE = r"""
mit; permission granted charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit; permission copyright notice; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0; permission granted charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .{0,160}? and to permit persons to whom the software is furnished to do so the software is provided
isc; permission modify fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc; permission modify fee; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
0bsd; permission modify fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-4-clause; advertising acknowledgement; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause; neither endorse; neither the name of .{1,120}? may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause; endorse names; the names? of .{1,120}? may not be used to endorse or promote products derived from this software
bsd-2-clause; redistribution source binary; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause-patent; redistribution patent; subject to the terms and conditions of this <l> each copyright holder and contributor hereby grants .{0,200}? patent <l>
apache-2.0; apache file except; licensed under the apache <l> <v>2 0 the <l> you may not use this file except in compliance with the <l>
apache-2.0; apache copy obtain; you may obtain a copy of the <l> at (?:https? )?(?:www )?apache org <l>s <l> 2 0
apache-1.1; apache redistribution software; this product includes software developed by the apache software foundation
gpl-3.0-or-later; redistribute gnu general; redistribute it and or modify it under the terms of the gnu general public <l> as published by the free software foundation either <v>3 of the <l> or at your option any later version
gpl-2.0-or-later; redistribute gnu general; redistribute it and or modify it under the terms of the gnu general public <l> as published by the free software foundation either <v>2 of the <l> or at your option any later version
gpl-3.0-only; redistribute gnu general; redistribute it and or modify it under the terms of the gnu general public <l> <v>3 (?:only )?as published by the free software foundation
gpl-2.0-only; redistribute gnu general; redistribute it and or modify it under the terms of the gnu general public <l> <v>2 (?:only )?as published by the free software foundation
gpl-2.0-only; gnu general published; terms of the gnu general public <l> <v>2 as published by the free software foundation
lgpl-3.0-or-later; redistribute gnu lesser; redistribute it and or modify it under the terms of the gnu lesser general public <l> as published by the free software foundation either <v>3 of the <l> or at your option any later version
lgpl-2.1-or-later; redistribute gnu lesser; redistribute it and or modify it under the terms of the gnu lesser general public <l> as published by the free software foundation either <v>2 1 of the <l> or at your option any later version
lgpl-2.0-or-later; redistribute gnu library; redistribute it and or modify it under the terms of the gnu library general public <l> as published by the free software foundation either <v>2 of the <l> or at your option any later version
agpl-3.0-or-later; redistribute gnu affero; redistribute it and or modify it under the terms of the gnu affero general public <l> as published by the free software foundation either <v>3 of the <l> or at your option any later version
gfdl-1.3-or-later; gnu documentation granted; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation <l> <v>1 3 or any later version
gfdl-1.2-or-later; gnu documentation granted; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation <l> <v>1 2 or any later version
gfdl-1.1-or-later; gnu documentation granted; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation <l> <v>1 1 or any later version
mpl-2.0; mozilla subject form; this source code form is subject to the terms of the mozilla public <l> <v>2 0
mpl-1.1; mozilla contents subject; the contents of this file are subject to the mozilla public <l> <v>1 1
mpl-1.0; mozilla contents subject; the contents of this file are subject to the mozilla public <l> <v>1 0
npl-1.1; netscape contents subject; the contents of this file are subject to the netscape public <l> <v>1 1
epl-2.0; eclipse accompanying; this program and the accompanying materials are made available under the terms of the eclipse public <l> <v>2 0
epl-1.0; eclipse accompanying; this program and the accompanying materials are made available under the terms of the eclipse public <l> <v>1 0
cddl-1.0; common development distribution; the contents of this file are subject to the terms of the common development and distribution <l>
unlicense; unencumbered domain; this is free and unencumbered software released into the public domain
cc0-1.0; waived copyright related; waived all copyright and related or neighbou?ring rights
zlib; altered misrepresented origin; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; altered misrepresented; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0; boost permission organization; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this <l>
wtfpl; fuck want; you just do what the fuck you want to
postgresql; postgresql permission fee; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ofl-1.1; font licensed sil; this font software is licensed under the sil open font <l> <v>1 1
artistic-2.0; artistic larry standard; copyright holder of the standard version .{0,80}? artistic <l> 2 0
x11; x consortium advertising; except as contained in this notice the name of the x consortium shall not be used in advertising
curl; advertising holder curl; the name of a copyright holder shall not be used in advertising or otherwise to promote the sale
ncsa; illinois endorse names; neither the names of .{1,120}? illinois .{0,120}? may be used to endorse or promote products derived from this software
python-2.0; python software foundation agreement; this <l> agreement is between the python software foundation psf and the individual or organization
json; software good evil; the software shall be used for good not evil
beerware; beer worth return; if we meet some day and you think this stuff is worth it you can buy me a beer in return
warranty-disclaimer; warranty merchantability; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
warranty-disclaimer; warranty merchantability; without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
warranty-disclaimer; warranties basis conditions; distributed on an as is basis without warranties or conditions of any kind
cc-by-4.0; creative commons attribution licensed; this work is licensed under a creative commons attribution 4 0 international <l>
cc-by-sa-4.0; creative commons sharealike licensed; this work is licensed under a creative commons attribution sharealike 4 0 international <l>
cc-by-nc-4.0; creative commons noncommercial licensed; this work is licensed under a creative commons attribution noncommercial 4 0 international <l>
cc-by-nd-4.0; creative commons noderivatives licensed; this work is licensed under a creative commons attribution noderivatives 4 0 international <l>
proprietary; confidential proprietary; (?:this (?:document|file|software) (?:contains|is) )?(?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary; reproduction prohibited; unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: (?:or|and) \w+)? (?:of this \w+ |via any medium )?is (?:strictly )?prohibited
no-redistribution; reproduced permission; no part of this (?:publication|book|work|document|site) may be reproduced
public-domain; public domain dedicated; (?:dedicated|released|placed|put|is) (?:in|into|to|in to) the public domain
"""

TITLE = r"""
apache-2.0; apache; apache(?: software foundation)? <l> <v>2(?: 0)?
apache-1.1; apache; apache(?: software)? <l> <v>1 1
apache-1.0; apache; apache(?: software)? <l> <v>1 0
gpl-3.0-or-later; general public; (?:gnu )?general public <l> <v>3(?: 0)?(?: of the <l>)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-or-later; general public; (?:gnu )?general public <l> <v>2(?: 0)?(?: of the <l>)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-only; general public; (?:gnu )?general public <l> <v>3(?: 0)?
gpl-2.0-only; general public; (?:gnu )?general public <l> <v>2(?: 0)?
gpl-1.0-only; general public; (?:gnu )?general public <l> <v>1(?: 0)?
lgpl-3.0-only; lesser general; (?:gnu )?lesser general public <l> <v>3(?: 0)?
lgpl-2.1-only; lesser general; (?:gnu )?lesser general public <l> <v>2 1
lgpl-2.0-only; library general; (?:gnu )?library general public <l> <v>2(?: 0)?
agpl-3.0-only; affero general; (?:gnu )?affero general public <l> <v>3(?: 0)?
agpl-1.0-only; affero general; affero general public <l> <v>1(?: 0)?
gfdl-1.3-only; free documentation; (?:gnu )?free documentation <l> <v>1 3
gfdl-1.2-only; free documentation; (?:gnu )?free documentation <l> <v>1 2
gfdl-1.1-only; free documentation; (?:gnu )?free documentation <l> <v>1 1
mpl-2.0; mozilla public; mozilla public <l> <v>2(?: 0)?
mpl-1.1; mozilla public; mozilla public <l> <v>1 1
mpl-1.0; mozilla public; mozilla public <l> <v>1 0
epl-2.0; eclipse public; eclipse public <l> <v>2(?: 0)?
epl-1.0; eclipse public; eclipse public <l> <v>1(?: 0)?
edl-1.0; eclipse distribution; eclipse distribution <l> <v>1 0
cddl-1.1; common development distribution; common development and distribution <l> (?:cddl )?<v>1 1
cddl-1.0; common development distribution; common development and distribution <l> (?:cddl )?<v>1 0
cpl-1.0; common public; common public <l> <v>1 0
ipl-1.0; ibm public; ibm public <l> <v>1 0
eupl-1.2; european union public; european union public <l> <v>1 2
eupl-1.1; european union public; european union public <l> <v>1 1
eupl-1.0; european union public; european union public <l> <v>1 0
artistic-2.0; artistic; artistic <l> <v>2(?: 0)?
artistic-1.0; artistic; artistic <l> <v>1(?: 0)?
ofl-1.1; open font; (?:sil )?open font <l> <v>1 1
ofl-1.0; open font; (?:sil )?open font <l> <v>1 0
bsl-1.0; boost software; boost software <l> <v>1 0
bsl-1.0; boost software; boost software <l>
busl-1.1; business source; business source <l> <v>1 1
osl-3.0; open software; open software <l> <v>3 0
osl-2.1; open software; open software <l> <v>2 1
afl-3.0; academic free; academic free <l> <v>3 0
afl-2.1; academic free; academic free <l> <v>2 1
ms-pl; microsoft public; microsoft public <l>
ms-rl; microsoft reciprocal; microsoft reciprocal <l>
php-3.01; php; php <l> <v>3 01
php-3.0; php; php <l> <v>3 0
zpl-2.1; zope public; zope public <l> <v>2 1
zpl-2.0; zope public; zope public <l> <v>2 0
python-2.0; python; python(?: software foundation)? <l> <v>2(?: 0)?
openssl; openssl; openssl <l>
cecill-2.1; cecill; cecill(?: free software)?(?: <l>)?(?: agreement)? <v>2 1
cecill-2.0; cecill; cecill(?: free software)?(?: <l>)?(?: agreement)? <v>2 0
cecill-b; cecill; cecill b
cecill-c; cecill; cecill c
lppl-1.3c; latex project; latex project public <l> <v>1 3c?
ecl-2.0; educational community; educational community <l> <v>2 0
upl-1.0; universal permissive; universal permissive <l>(?: <v>1 0)?
unicode-dfs-2016; unicode data files; unicode (?:inc )?<l> agreement data files and software
ncsa; illinois ncsa; university of illinois (?:ncsa )?open source <l>
cern-ohl-s-2.0; cern open hardware; cern open hardware (?:licence|<l>) <v>2 strongly reciprocal
cern-ohl-p-2.0; cern open hardware; cern open hardware (?:licence|<l>) <v>2 permissive
cern-ohl-1.2; cern open hardware; cern open hardware <l> <v>1 2
odbl-1.0; open database; (?:open data commons )?open database <l>(?: odbl)?(?: <v>1 0)?
odc-by-1.0; open data commons attribution; open data commons attribution <l>(?: <v>1 0)?
pddl-1.0; public domain dedication open data; open data commons public domain dedication and <l>
ogl-uk-3.0; open government; open government <l> <v>3(?: 0)?
ogl-uk-2.0; open government; open government <l> <v>2(?: 0)?
etalab-2.0; etalab; (?:licence ouverte|open licence) (?:etalab )?<v>2(?: 0)?
dl-de-by-2.0; datenlizenz; datenlizenz deutschland namensnennung <v>2 0
sspl-1.0; server side public; server side public <l>(?: <v>1)?
elastic-2.0; elastic; elastic <l> <v>2(?: 0)?
polyform-noncommercial-1.0.0; polyform noncommercial; polyform noncommercial <l>(?: 1 0 0)?
polyform-small-business-1.0.0; polyform small business; polyform small business <l>(?: 1 0 0)?
blueoak-1.0.0; blue oak; blue oak model <l>(?: <v>1 0 0)?
openrail; rail; (?:creativeml )?open rail(?: m)?(?: <l>)?
openrail; bigscience rail; bigscience (?:bloom )?rail <l>(?: <v>1 0)?
cc-by-nc-sa-4.0; creative commons; creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: <l>)?
cc-by-nc-nd-4.0; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?(?: public)?(?: <l>)?
cc-by-nc-4.0; creative commons; creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: <l>)?
cc-by-nd-4.0; creative commons; creative commons attribution no ?deriv(?:ative)?s? 4 0(?: international)?(?: public)?(?: <l>)?
cc-by-sa-4.0; creative commons; creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: <l>)?
cc-by-4.0; creative commons; creative commons attribution 4 0(?: international)?(?: public)?(?: <l>)?
cc-by-nc-sa-3.0; creative commons; creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: <l>)?
cc-by-nc-nd-3.0; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s? 3 0(?: unported)?(?: <l>)?
cc-by-nc-3.0; creative commons; creative commons attribution non ?commercial 3 0(?: unported)?(?: <l>)?
cc-by-nd-3.0; creative commons; creative commons attribution no ?deriv(?:ative)?s? 3 0(?: unported)?(?: <l>)?
cc-by-sa-3.0; creative commons; creative commons attribution share ?alike 3 0(?: unported)?(?: <l>)?
cc-by-3.0; creative commons; creative commons attribution 3 0(?: unported)?(?: <l>)?
cc-by-sa-2.0; creative commons; creative commons attribution share ?alike 2 0(?: generic)?(?: <l>)?
cc-by-2.0; creative commons; creative commons attribution 2 0(?: generic)?(?: <l>)?
cc0-1.0; cc0; cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0; creative commons zero; creative commons zero(?: <v>1 0)?(?: universal)?
"""

IDENTIFIER = r"""
mit; spdx; spdx <l> identifier mit
mit-0; spdx; spdx <l> identifier mit 0
isc; spdx; spdx <l> identifier isc
0bsd; spdx; spdx <l> identifier 0bsd
bsd-2-clause; spdx; spdx <l> identifier bsd 2 clause
bsd-3-clause; spdx; spdx <l> identifier bsd 3 clause
bsd-4-clause; spdx; spdx <l> identifier bsd 4 clause
apache-2.0; spdx; spdx <l> identifier apache 2 0
gpl-2.0-only; spdx; spdx <l> identifier gpl 2 0(?: only)?
gpl-2.0-or-later; spdx; spdx <l> identifier gpl 2 0 or later
gpl-3.0-only; spdx; spdx <l> identifier gpl 3 0(?: only)?
gpl-3.0-or-later; spdx; spdx <l> identifier gpl 3 0 or later
lgpl-2.1-only; spdx; spdx <l> identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later; spdx; spdx <l> identifier lgpl 2 1 or later
lgpl-3.0-only; spdx; spdx <l> identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later; spdx; spdx <l> identifier lgpl 3 0 or later
agpl-3.0-only; spdx; spdx <l> identifier agpl 3 0(?: only)?
agpl-3.0-or-later; spdx; spdx <l> identifier agpl 3 0 or later
mpl-2.0; spdx; spdx <l> identifier mpl 2 0
epl-2.0; spdx; spdx <l> identifier epl 2 0
cddl-1.0; spdx; spdx <l> identifier cddl 1 0
cc0-1.0; spdx; spdx <l> identifier cc0 1 0
cc-by-4.0; spdx; spdx <l> identifier cc by 4 0
cc-by-sa-4.0; spdx; spdx <l> identifier cc by sa 4 0
unlicense; spdx; spdx <l> identifier unlicense
zlib; spdx; spdx <l> identifier zlib
bsl-1.0; spdx; spdx <l> identifier bsl 1 0
cc-by-nc-sa-4.0; cc by nc sa; cc by nc sa <v>4 0
cc-by-nc-nd-4.0; cc by nc nd; cc by nc nd <v>4 0
cc-by-nc-4.0; cc by nc; cc by nc <v>4 0
cc-by-nd-4.0; cc by nd; cc by nd <v>4 0
cc-by-sa-4.0; cc by sa; cc by sa <v>4 0
cc-by-4.0; cc by; cc by <v>4 0
cc-by-nc-sa-3.0; cc by nc sa; cc by nc sa <v>3 0
cc-by-nc-nd-3.0; cc by nc nd; cc by nc nd <v>3 0
cc-by-nc-3.0; cc by nc; cc by nc <v>3 0
cc-by-nd-3.0; cc by nd; cc by nd <v>3 0
cc-by-sa-3.0; cc by sa; cc by sa <v>3 0
cc-by-3.0; cc by; cc by <v>3 0
cc-by-sa-2.5; cc by sa; cc by sa <v>2 5
cc-by-2.5; cc by; cc by <v>2 5
cc-by-sa-2.0; cc by sa; cc by sa <v>2 0
cc-by-2.0; cc by; cc by <v>2 0
gpl-3.0-or-later; gplv3; gplv3 or later
gpl-2.0-or-later; gplv2; gplv2 or later
gpl-3.0-only; gplv3; (?:gnu )?gplv3
gpl-2.0-only; gplv2; (?:gnu )?gplv2
gpl-3.0-only; gpl; (?:gnu )?gpl <v>3(?: 0)?
gpl-2.0-only; gpl; (?:gnu )?gpl <v>2(?: 0)?
lgpl-3.0-only; lgplv3; (?:gnu )?lgplv3
lgpl-2.1-only; lgpl; (?:gnu )?lgpl <v>2 1
lgpl-3.0-only; lgpl; (?:gnu )?lgpl <v>3(?: 0)?
agpl-3.0-only; agplv3; (?:gnu )?agplv3
agpl-3.0-only; agpl; (?:gnu )?agpl <v>3(?: 0)?
mpl-2.0; mpl; mpl <v>2(?: 0)?
epl-2.0; epl; epl <v>2 0
eupl-1.2; eupl; eupl <v>1 2
cddl-1.0; cddl; cddl <v>1 0
bsd-2-clause; bsd; bsd 2 clause(?: <l>)?
bsd-3-clause; bsd; bsd 3 clause(?: <l>)?
bsd-4-clause; bsd; bsd 4 clause(?: <l>)?
bsd-2-clause; bsd clause; (?:2|two) clause bsd(?: <l>)?
bsd-3-clause; bsd clause; (?:3|three) clause bsd(?: <l>)?
bsd-4-clause; bsd clause; (?:4|four) clause bsd(?: <l>)?
apache-2.0; apache; apache 2(?: 0)?
"""

ADDRESS = r"""
apache-2.0; apache org; (?:https? )?(?:www )?apache org <l>s <l> 2 0(?: txt| html)?
apache-1.1; apache org; (?:https? )?(?:www )?apache org <l>s <l> 1 1(?: txt| html)?
mit; opensource org mit; (?:https? )?(?:www )?opensource org <l>s? mit(?: <l>)?(?: php| html)?
bsd-2-clause; opensource org bsd; (?:https? )?(?:www )?opensource org <l>s? bsd 2 clause
bsd-3-clause; opensource org bsd; (?:https? )?(?:www )?opensource org <l>s? bsd 3 clause
isc; opensource org isc; (?:https? )?(?:www )?opensource org <l>s? isc
zlib; opensource org zlib; (?:https? )?(?:www )?opensource org <l>s? zlib
artistic-2.0; opensource org artistic; (?:https? )?(?:www )?opensource org <l>s? artistic <l> 2 0
gpl-3.0-only; gnu org gpl; (?:https? )?(?:www )?gnu org <l>s gpl 3 0(?: \w+)?
gpl-2.0-only; gnu org gpl; (?:https? )?(?:www )?gnu org <l>s (?:old <l>s )?gpl 2 0(?: \w+)?
gpl; gnu org gpl; (?:https? )?(?:www )?gnu org <l>s gpl(?: html| txt)?
lgpl-3.0-only; gnu org lgpl; (?:https? )?(?:www )?gnu org <l>s lgpl 3 0(?: \w+)?
lgpl-2.1-only; gnu org lgpl; (?:https? )?(?:www )?gnu org <l>s (?:old <l>s )?lgpl 2 1(?: \w+)?
agpl-3.0-only; gnu org agpl; (?:https? )?(?:www )?gnu org <l>s agpl 3 0(?: \w+)?
gfdl; gnu org fdl; (?:https? )?(?:www )?gnu org <l>s fdl(?: 1 [123])?(?: \w+)?
gpl; gnu org; (?:https? )?(?:www )?gnu org <l>s
mpl-2.0; mozilla org; (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-1.1; mozilla org; (?:https? )?(?:www )?mozilla org mpl mpl 1 1(?: html)?
epl-2.0; eclipse org; (?:https? )?(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?
epl-1.0; eclipse org; (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
cc-by-4.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by 4 0
cc-by-sa-4.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by sa 4 0
cc-by-nc-4.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nc 4 0
cc-by-nd-4.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nd 4 0
cc-by-nc-sa-4.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nc sa 4 0
cc-by-nc-nd-4.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nc nd 4 0
cc-by-3.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by 3 0(?: \w\w)?
cc-by-sa-3.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by sa 3 0(?: \w\w)?
cc-by-nc-3.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nc 3 0(?: \w\w)?
cc-by-nd-3.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nd 3 0(?: \w\w)?
cc-by-nc-sa-3.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nc sa 3 0(?: \w\w)?
cc-by-nc-nd-3.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by nc nd 3 0(?: \w\w)?
cc-by-sa-2.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by sa 2 [05]
cc-by-2.0; creativecommons org; (?:https? )?(?:www )?creativecommons org <l>s by 2 [05]
cc0-1.0; creativecommons org zero; (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
public-domain; creativecommons org mark; (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
unlicense; unlicense org; (?:https? )?(?:www )?unlicense org
bsl-1.0; boost org; (?:https? )?(?:www )?boost org <l> 1 0(?: txt)?
ofl-1.1; scripts sil org; (?:https? )?scripts sil org ofl
wtfpl; wtfpl net; (?:https? )?(?:www )?wtfpl net
odbl-1.0; opendatacommons org odbl; (?:https? )?(?:www )?opendatacommons org <l>s odbl(?: 1 0)?
pddl-1.0; opendatacommons org pddl; (?:https? )?(?:www )?opendatacommons org <l>s pddl(?: 1 0)?
odc-by-1.0; opendatacommons org by; (?:https? )?(?:www )?opendatacommons org <l>s by(?: 1 0)?
python-2.0; python org psf; (?:https? )?docs python org .{0,20}?<l>
php-3.01; php net; (?:https? )?(?:www )?php net <l> 3 01(?: txt)?
"""

NAME = r"""
mit; mit; (?:the )?mit <l>
mit; mit; (?:released|licensed|available|distributed) under (?:the )?mit
mit; expat; expat <l>
isc; isc; (?:the )?isc <l>
bsd; bsd; (?:the )?(?:new |modified |simplified |revised )?bsd(?: style)? <l>
apache; apache; apache(?: software)? <l>
lgpl; lesser general public; (?:gnu )?lesser general public <l>
lgpl; library general public; (?:gnu )?library general public <l>
agpl; affero general public; (?:gnu )?affero general public <l>
gpl; gnu general public; gnu general public <l>
gpl; gpl; (?:gnu )?gpl(?: <l>)?
lgpl; lgpl; (?:gnu )?lgpl(?: <l>)?
agpl; agpl; (?:gnu )?agpl(?: <l>)?
gfdl; free documentation; (?:gnu )?free documentation <l>
gfdl; gfdl; (?:gnu )?gfdl
mpl; mozilla public; mozilla public <l>
epl; eclipse public; eclipse public <l>
eupl; european union public; european union public <l>
eupl; eupl; eupl
cddl; common development distribution; common development and distribution <l>
cddl; cddl; cddl
artistic; artistic; (?:perl )?artistic <l>
ofl; open font; (?:sil )?open font <l>
zlib; zlib; zlib(?: libpng)? <l>
unlicense; unlicense; (?:the )?unlicense
wtfpl; wtfpl; wtfpl
wtfpl; fuck want public; do what the fuck you want to public <l>
python; python; python(?: software foundation)? <l>
php; php; php <l>
ruby; ruby; ruby(?: s)? <l>
perl; perl terms; same terms as perl itself
postgresql; postgresql; postgresql <l>
x11; x11; x11 <l>
ncsa; ncsa; ncsa(?: open source)? <l>
zpl; zope public; zope public <l>
w3c; w3c; w3c software (?:notice and )?<l>
beerware; beerware; beerware(?: <l>)?
beerware; beer ware; beer ware(?: <l>)?
json; json; json <l>
openrail; openrail; (?:creativeml |bigcode )?openrail(?: m)?(?: <l>)?
llama; llama community; llama (?:\d+ )?(?:\d+ )?community <l>(?: agreement)?
gemma; gemma terms; gemma terms of use
sspl; sspl; sspl
busl; business source; business source <l>
commons-clause; commons clause; commons clause(?: <l> condition)?
elastic; elastic; elastic <l>
polyform; polyform; polyform(?: \w+)? <l>
cecill; cecill; cecill
ogl; open government; open government <l>
odbl; odbl; odbl
odbl; open database; open database <l>
cc-by-nc-sa; cc by nc sa; cc by nc sa
cc-by-nc-nd; cc by nc nd; cc by nc nd
cc-by-nc; cc by nc; cc by nc
cc-by-nd; cc by nd; cc by nd
cc-by-sa; cc by sa; cc by sa
cc-by-nc-sa; creative commons; creative commons attribution non ?commercial share ?alike(?: <l>)?
cc-by-nc-nd; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: <l>)?
cc-by-nc; creative commons; creative commons attribution non ?commercial(?: <l>)?
cc-by-nd; creative commons; creative commons attribution no ?deriv(?:ative)?s?(?: <l>)?
cc-by-sa; creative commons; creative commons attribution share ?alike(?: <l>)?
cc-by; creative commons; creative commons attribution(?: <l>)?
creative-commons; creative commons; creative commons(?: <l>)?
creative-commons; creative commons; <l> creative commons
creative-commons; creative commons; creative commons (?:lizenz|licencia)
public-domain; public domain; public domain
proprietary; proprietary; proprietary <l>
proprietary; commercial; commercial <l>
gpl; gnu lizenz; gnu (?:allgemeine öffentliche )?lizenz
gpl; licence publique générale; licence publique générale(?: gnu)?
gpl; licencia pública general; licencia pública general(?: de)?(?: gnu)?
mit; mit lizenz; mit lizenz
mit; licence mit; licence mit
mit; licencia mit; licencia mit
apache; apache lizenz; apache lizenz
apache; licence apache; licence apache
apache; licencia apache; licencia apache
"""

HINT = r"""
license-reference; licensed; (?:dual )?licensed under
license-reference; released; released under
license-reference; under terms; under the terms of (?:the|this) \w+(?: \w+)? <l>
license-reference; see for; see (?:the )?<l>(?: file)?(?: txt| md)? for (?:details|more|the full|terms)
license-reference; subject license; subject to the terms of (?:the|this) <l>
license-reference; lizenz; (?:lizenziert unter|unter der lizenz|veröffentlicht unter der lizenz)
license-reference; lizenziert; lizenziert unter
license-reference; sous licence; sous (?:la )?licence
license-reference; bajo licencia; bajo (?:la )?licencia
license-reference; end user agreement; end user <l> agreement
license-reference; open source; open source <l>
copyright; copyright; copyright(?: c| ©)?(?: \d{4})?
copyright; ©; © ?\d{4}
reserved; rights reserved; (?:all )?rights reserved
reserved; alle rechte vorbehalten; alle rechte vorbehalten
reserved; tous droits réservés; tous droits réservés
reserved; todos derechos reservados; todos los derechos reservados
reserved; some rights reserved; some rights reserved
"""

#: Phrases that always count, each with its label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

TABLE = {"notice": NOTICE, "title": TITLE, "identifier": IDENTIFIER, "address": ADDRESS, "name": NAME, "hint": HINT}


def rules() -> list[tuple[str, str, frozenset[str], str]]:
    """(section, label, keywords, pattern) in order."""
    out = []
    for section, lines in TABLE.items():
        for line in lines.strip().splitlines():
            label, keywords, pattern = (x.strip() for x in line.split(";", 2))
            pattern = pattern.replace("<v>", "(?:version |ver |v )?v?").replace("<l>", "licen[cs]e")
            out.append((section, label, frozenset(keywords.split()), pattern))
    return out
