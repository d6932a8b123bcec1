"""Signature rules for license scans, in order: priority, confidence, label, keywords, pattern.

A pattern is a regular expression over the text's words in lower case with one blank between them, so signs are blanks:
"GPL-3.0" reads "gpl 3 0". It matches whole words. Its keywords must all be among the words of a text for it to be tried.
So every text that the pattern matches must hold them all: a word of only some alternatives is no keyword.
Priorities: 4 a tag or an address that names one license, 3 words of a license's own text, 2 a license's name with its
version, 1 a name or notice alone.
"""

from __future__ import annotations

RULES = r"""
4 1.00 mit | spdx mit | spdx license identifier mit
4 1.00 mit-0 | spdx mit 0 | spdx license identifier mit 0
4 1.00 apache-2.0 | spdx apache | spdx license identifier apache 2 0
4 1.00 apache-1.1 | spdx apache | spdx license identifier apache 1 1
4 1.00 apache-1.0 | spdx apache | spdx license identifier apache 1 0
4 1.00 bsd-0-clause | spdx 0bsd | spdx license identifier 0bsd
4 1.00 bsd-1-clause | spdx bsd | spdx license identifier bsd 1 clause
4 1.00 bsd-2-clause | spdx bsd | spdx license identifier bsd 2 clause
4 1.00 bsd-3-clause | spdx bsd | spdx license identifier bsd 3 clause
4 1.00 bsd-4-clause | spdx bsd | spdx license identifier bsd 4 clause
4 1.00 gpl-1.0 | spdx gpl | spdx license identifier gpl 1 0(?: only| or later)?
4 1.00 gpl-2.0 | spdx gpl | spdx license identifier gpl 2 0(?: only| or later)?
4 1.00 gpl-3.0 | spdx gpl | spdx license identifier gpl 3 0(?: only| or later)?
4 1.00 lgpl-2.0 | spdx lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
4 1.00 lgpl-2.1 | spdx lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
4 1.00 lgpl-3.0 | spdx lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
4 1.00 agpl-3.0 | spdx agpl | spdx license identifier agpl 3 0(?: only| or later)?
4 1.00 mpl-1.1 | spdx mpl | spdx license identifier mpl 1 1
4 1.00 mpl-2.0 | spdx mpl | spdx license identifier mpl 2 0
4 1.00 epl-1.0 | spdx epl | spdx license identifier epl 1 0
4 1.00 epl-2.0 | spdx epl | spdx license identifier epl 2 0
4 1.00 cddl-1.0 | spdx cddl | spdx license identifier cddl 1 0
4 1.00 cddl-1.1 | spdx cddl | spdx license identifier cddl 1 1
4 1.00 eupl-1.1 | spdx eupl | spdx license identifier eupl 1 1
4 1.00 eupl-1.2 | spdx eupl | spdx license identifier eupl 1 2
4 1.00 isc | spdx isc | spdx license identifier isc
4 1.00 zlib | spdx zlib | spdx license identifier zlib
4 1.00 boost-1.0 | spdx bsl | spdx license identifier bsl 1 0
4 1.00 unlicense | spdx unlicense | spdx license identifier unlicense
4 1.00 wtfpl | spdx wtfpl | spdx license identifier wtfpl
4 1.00 cc0-1.0 | spdx cc0 | spdx license identifier cc0 1 0
4 1.00 cc-by-3.0 | spdx cc by | spdx license identifier cc by 3 0
4 1.00 cc-by-4.0 | spdx cc by | spdx license identifier cc by 4 0
4 1.00 cc-by-sa-3.0 | spdx cc by sa | spdx license identifier cc by sa 3 0
4 1.00 cc-by-sa-4.0 | spdx cc by sa | spdx license identifier cc by sa 4 0
4 1.00 cc-by-nc-4.0 | spdx cc by nc | spdx license identifier cc by nc 4 0
4 1.00 cc-by-nd-4.0 | spdx cc by nd | spdx license identifier cc by nd 4 0
4 1.00 cc-by-nc-sa-4.0 | spdx cc by nc sa | spdx license identifier cc by nc sa 4 0
4 1.00 cc-by-nc-nd-4.0 | spdx cc by nc nd | spdx license identifier cc by nc nd 4 0
4 1.00 artistic-2.0 | spdx artistic | spdx license identifier artistic 2 0
4 1.00 postgresql | spdx postgresql | spdx license identifier postgresql
4 1.00 psf-2.0 | spdx 2 0 | spdx license identifier (?:psf|python) 2 0
4 1.00 ofl-1.1 | spdx ofl | spdx license identifier ofl 1 1
4 1.00 ncsa | spdx ncsa | spdx license identifier ncsa
4 1.00 upl-1.0 | spdx upl | spdx license identifier upl 1 0
4 1.00 ms-pl | spdx ms pl | spdx license identifier ms pl
4 1.00 busl-1.1 | spdx busl | spdx license identifier busl 1 1
4 1.00 sspl-1.0 | spdx sspl | spdx license identifier sspl 1 0
4 1.00 elastic-2.0 | spdx elastic | spdx license identifier elastic 2 0
4 0.95 apache-2.0 | apache licenses | apache org licenses license 2 0
4 0.95 apache-1.1 | apache licenses | apache org licenses license 1 1
4 0.95 mit | opensource org mit | opensource org licenses? mit(?: license)?
4 0.95 bsd-2-clause | opensource org bsd | opensource org licenses? bsd 2 clause
4 0.95 bsd-3-clause | opensource org bsd | opensource org licenses? bsd 3 clause
4 0.95 isc | opensource org isc | opensource org licenses? isc
4 0.95 gpl | gnu org gpl | gnu org (?:licenses|copyleft) gpl(?: html| txt)?
4 0.95 gpl-2.0 | gnu licenses gpl | gnu org licenses (?:old licenses )?gpl 2 0
4 0.95 gpl-3.0 | gnu licenses gpl | gnu org licenses gpl 3 0
4 0.95 lgpl | gnu org | gnu org (?:licenses|copyleft) (?:lgpl|lesser)
4 0.95 lgpl-2.1 | gnu licenses lgpl | gnu org licenses (?:old licenses )?lgpl 2 1
4 0.95 lgpl-3.0 | gnu licenses lgpl | gnu org licenses lgpl 3 0
4 0.95 agpl-3.0 | gnu licenses agpl | gnu org licenses agpl(?: 3 0)?
4 0.95 gfdl | gnu org fdl | gnu org (?:licenses|copyleft) fdl
4 0.95 mpl-1.1 | mozilla mpl | mozilla org mpl(?: mpl)? 1 1
4 0.95 mpl-2.0 | mozilla mpl | mozilla org (?:en us )?mpl 2 0
4 0.95 epl-1.0 | eclipse legal epl | eclipse org legal epl v10
4 0.95 epl-2.0 | eclipse legal epl | eclipse org legal epl (?:2 0|v20)
4 0.95 cc0-1.0 | creativecommons publicdomain zero | creativecommons org publicdomain zero 1 0
4 0.95 cc-pdm-1.0 | creativecommons publicdomain mark | creativecommons org publicdomain mark 1 0
4 0.95 cc-by-1.0 | creativecommons licenses by | creativecommons org licenses by 1 0
4 0.95 cc-by-2.0 | creativecommons licenses by | creativecommons org licenses by 2 0
4 0.95 cc-by-2.5 | creativecommons licenses by | creativecommons org licenses by 2 5
4 0.95 cc-by-3.0 | creativecommons licenses by | creativecommons org licenses by 3 0
4 0.95 cc-by-4.0 | creativecommons licenses by | creativecommons org licenses by 4 0
4 0.95 cc-by-sa-2.0 | creativecommons licenses by sa | creativecommons org licenses by sa 2 0
4 0.95 cc-by-sa-2.5 | creativecommons licenses by sa | creativecommons org licenses by sa 2 5
4 0.95 cc-by-sa-3.0 | creativecommons licenses by sa | creativecommons org licenses by sa 3 0
4 0.95 cc-by-sa-4.0 | creativecommons licenses by sa | creativecommons org licenses by sa 4 0
4 0.95 cc-by-nc-2.0 | creativecommons licenses by nc | creativecommons org licenses by nc 2 0
4 0.95 cc-by-nc-3.0 | creativecommons licenses by nc | creativecommons org licenses by nc 3 0
4 0.95 cc-by-nc-4.0 | creativecommons licenses by nc | creativecommons org licenses by nc 4 0
4 0.95 cc-by-nd-3.0 | creativecommons licenses by nd | creativecommons org licenses by nd 3 0
4 0.95 cc-by-nd-4.0 | creativecommons licenses by nd | creativecommons org licenses by nd 4 0
4 0.95 cc-by-nc-sa-3.0 | creativecommons licenses by nc sa | creativecommons org licenses by nc sa 3 0
4 0.95 cc-by-nc-sa-4.0 | creativecommons licenses by nc sa | creativecommons org licenses by nc sa 4 0
4 0.95 cc-by-nc-nd-3.0 | creativecommons licenses by nc nd | creativecommons org licenses by nc nd 3 0
4 0.95 cc-by-nc-nd-4.0 | creativecommons licenses by nc nd | creativecommons org licenses by nc nd 4 0
4 0.95 unlicense | unlicense org | unlicense org
4 0.95 wtfpl | wtfpl net | wtfpl net
4 0.95 boost-1.0 | boost license 1 0 | boost org license 1 0
4 0.95 odbl-1.0 | opendatacommons licenses odbl | opendatacommons org licenses odbl
4 0.95 odc-by-1.0 | opendatacommons licenses by | opendatacommons org licenses by
4 0.95 pddl-1.0 | opendatacommons licenses pddl | opendatacommons org licenses pddl
4 0.95 ofl-1.1 | scripts sil ofl | scripts sil org ofl
4 0.95 busl-1.1 | mariadb bsl11 | mariadb com bsl11
3 0.95 mit | permission hereby granted sublicense | permission is hereby granted free of charge to any person obtaining a copy(?: \S+){1,40} sublicense
3 0.90 mit | software provided warranty | the software is provided as is without warranty of any kind express or implied
3 0.95 isc | permission purpose hereby granted fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 0.90 hpnd | permission fee hereby granted documentation | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
3 0.95 apache-2.0 | licensed apache license | licensed under the apache license version 2 0
3 0.90 apache-2.0 | except compliance license | you may not use this (?:file|work) except in compliance with the license
3 0.90 apache-1.1 | includes developed apache foundation | this product includes software developed by the apache software foundation
3 0.90 bsd | redistribution source binary forms permitted | redistribution and use in source and binary forms with or without modification are permitted
3 0.95 bsd-3-clause | neither name contributors endorse | neither the name of(?: \S+){1,20} contributors may be used to endorse or promote
3 0.95 bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
3 0.90 gpl | free software redistribute gnu general | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
3 0.95 gpl-2.0 | terms gnu version | under the terms of(?: version 2 of)? the gnu general public license(?: as published by the free software foundation)? (?:either )?version 2
3 0.95 gpl-3.0 | terms gnu version | under the terms of(?: version 3 of)? the gnu general public license(?: as published by the free software foundation)? (?:either )?version 3
3 0.90 gpl | warranty merchantability gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
3 0.90 lgpl | library free software redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)
3 0.95 agpl-3.0 | terms gnu affero | under the terms of the gnu affero general public license
3 0.95 mpl-2.0 | source code form mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
3 0.95 mpl-1.1 | contents file mozilla | the contents of this file are subject to the mozilla public license version 1 1
3 0.95 epl-1.0 | accompanying materials eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )?1 0
3 0.95 epl-2.0 | accompanying materials eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion )?)?2 0
3 0.95 cddl-1.0 | contents file common distribution | the contents of this file are subject to the terms of the common development and distribution license
3 0.95 eupl-1.2 | licensed eupl | licensed under the eupl(?: version)? (?:v )?1 2
3 0.95 unlicense | free unencumbered software domain | this is free and unencumbered software released into the public domain
3 0.95 wtfpl | do what fuck want | do what the fuck you want to public license
3 0.95 zlib | altered source versions misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
3 0.95 boost-1.0 | distributed boost license | distributed under the boost software license version 1 0
3 0.95 ncsa | university illinois ncsa | university of illinois ncsa open source license
3 0.90 beerware | beer ware license | the beer ware license
3 0.95 json | software good evil | the software shall be used for good not evil
3 0.95 cc0-1.0 | waived copyright extent | to the extent possible under law(?: \S+){1,12} has waived all copyright
3 0.90 cc-by-4.0 | licensed creative commons attribution | licensed under (?:a |the )?creative commons attribution 4 0
3 0.90 cc-by-3.0 | licensed creative commons attribution | licensed under (?:a |the )?creative commons attribution 3 0
3 0.90 cc-by-sa-4.0 | licensed creative commons attribution | licensed under (?:a |the )?creative commons attribution share ?alike 4 0
3 0.90 cc-by-sa-3.0 | licensed creative commons attribution | licensed under (?:a |the )?creative commons attribution share ?alike 3 0
3 0.90 gfdl | permission document gnu free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
3 0.90 ofl-1.1 | font software licensed sil | this font software is licensed under the sil open font license
3 0.90 vim | vim charityware | vim is charityware
3 0.90 openssl | includes developed openssl | this product includes software developed by the openssl project
3 0.90 php-3.01 | includes php freely | this product includes php software freely available from
3 0.90 psf-2.0 | python foundation license agreement | this license agreement is between the python software foundation
3 0.90 proprietary | unauthorized copying file prohibited | unauthorized copying of this file via any medium is strictly prohibited
3 0.90 proprietary | reproduced without permission written | (?:may not|no part(?: \S+){0,6} may) be reproduced(?: \S+){0,12} without(?: the)? prior written permission
3 0.85 proprietary | proprietary confidential information | proprietary and confidential information
3 0.90 government-work | work united states government | this is a work of the united states government
2 0.90 mit | mit license | (?:the )?mit license(?: mit)?
2 0.90 mit | under mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit
2 0.85 mit | expat license | expat license
2 0.85 x11 | x11 license | x11 license
2 0.90 isc | isc license | isc license
2 0.90 apache-2.0 | apache license | apache (?:software )?license (?:version |v ?)?2(?: 0)?
2 0.90 apache-2.0 | apache 2 0 | apache 2 0
2 0.85 apache-2.0 | under apache 2 | (?:licensed|released|distributed|available) under (?:the )?apache 2
2 0.90 apache-1.1 | apache license | apache (?:software )?license (?:version |v ?)?1 1
2 0.90 bsd-2-clause | bsd 2 clause | (?:bsd 2 clause|2 clause bsd)
2 0.90 bsd-2-clause | simplified bsd license | simplified bsd license
2 0.90 bsd-2-clause | freebsd license | freebsd license
2 0.90 bsd-3-clause | bsd 3 clause | (?:bsd 3 clause|3 clause bsd)
2 0.90 bsd-3-clause | bsd license | (?:new|modified|revised) bsd license
2 0.90 bsd-4-clause | bsd 4 clause | (?:bsd 4 clause|4 clause bsd)
2 0.90 bsd-0-clause | zero clause bsd | zero clause bsd
2 0.90 gpl-1.0 | gpl | (?:gnu )?gpl (?:version |v ?)?1(?: 0)?
2 0.90 gpl-2.0 | gpl | (?:gnu )?gpl (?:version |v ?)?2(?: 0)?(?: only| or later| or any later version)?
2 0.90 gpl-3.0 | gpl | (?:gnu )?gpl (?:version |v ?)?3(?: 0)?(?: only| or later| or any later version)?
2 0.90 gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: only| or later)?
2 0.90 gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: only| or later)?
2 0.90 gpl-2.0 | gnu general public license | gnu general public license(?: gpl)? (?:version |v ?)2(?: 0)?
2 0.90 gpl-3.0 | gnu general public license | gnu general public license(?: gpl)? (?:version |v ?)3(?: 0)?
2 0.90 lgpl-2.1 | lgpl | (?:gnu )?lgpl (?:version |v ?)?2 1
2 0.90 lgpl-3.0 | lgpl | (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?
2 0.90 lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
2 0.90 lgpl-3.0 | lgplv3 | lgplv3
2 0.90 lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)?2 1
2 0.90 lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)?3
2 0.90 agpl-3.0 | agpl | (?:gnu )?agpl (?:version |v ?)?3(?: 0)?
2 0.90 agpl-3.0 | agplv3 | agplv3
2 0.90 agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:version |v ?)?3
2 0.90 mpl-1.1 | mozilla public license | mozilla public license (?:version |v ?)?1 1
2 0.90 mpl-2.0 | mozilla public license | mozilla public license (?:version |v ?)?2 0
2 0.90 mpl-2.0 | mpl 2 0 | mpl 2 0
2 0.90 epl-1.0 | eclipse public license | eclipse public license (?:version |v ?)?1 0
2 0.90 epl-2.0 | eclipse public license | eclipse public license (?:version |v ?)?2 0
2 0.90 cpl-1.0 | common public license | common public license(?: (?:version |v ?)?1 0)?
2 0.90 ibmpl-1.0 | ibm public license | ibm public license
2 0.90 eupl-1.1 | european union public | european union public licen[cs]e (?:version |v ?)?1 1
2 0.90 eupl-1.2 | european union public | european union public licen[cs]e (?:version |v ?)?1 2
2 0.90 artistic-1.0 | artistic license 1 0 | artistic license 1 0
2 0.90 artistic-2.0 | artistic license 2 0 | artistic license 2 0
2 0.90 cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
2 0.90 cc-by-1.0 | cc by 1 0 | cc by 1 0
2 0.90 cc-by-2.0 | cc by 2 0 | cc by 2 0
2 0.90 cc-by-3.0 | cc by 3 0 | cc by 3 0
2 0.90 cc-by-4.0 | cc by 4 0 | cc by 4 0
2 0.90 cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
2 0.90 cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
2 0.90 cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
2 0.90 cc-by-nd-4.0 | cc by nd 4 0 | cc by nd 4 0
2 0.90 cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0
2 0.90 cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0
2 0.90 busl-1.1 | business source license 1 1 | business source license 1 1
2 0.90 sspl-1.0 | server side public license | server side public license
2 0.90 elastic-2.0 | elastic license 2 0 | elastic license 2 0
2 0.90 openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?
2 0.90 openrail | open rail | (?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: license)?
2 0.90 llama | llama community license | llama (?:2 |3 |3 1 )?community license
1 0.70 cc-by-sa | cc by sa | cc by sa
1 0.70 cc-by-nc | cc by nc | cc by nc
1 0.70 cc-by-nd | cc by nd | cc by nd
1 0.70 cc-by-nc-sa | cc by nc sa | cc by nc sa
1 0.70 cc-by-nc-nd | cc by nc nd | cc by nc nd
1 0.60 creative-commons | creative commons | creative commons(?: licen[cs]e)?
1 0.70 cc-by | creative commons attribution | creative commons attribution(?: licen[cs]e)?
2 0.80 cc-by-sa-4.0 | creative commons attribution | creative commons attribution share ?alike 4 0
2 0.80 cc-by-sa-3.0 | creative commons attribution | creative commons attribution share ?alike 3 0
1 0.70 cc-by-sa | creative commons attribution | creative commons attribution share ?alike
1 0.70 lgpl | lesser general public license | (?:gnu )?lesser general public license
1 0.70 lgpl | library general public license | (?:gnu )?library general public license
1 0.70 agpl | affero general public license | (?:gnu )?affero general public license
1 0.70 gpl | gnu gpl | gnu gpl
1 0.60 gpl | gpl | gpl
1 0.60 lgpl | lgpl | lgpl
1 0.60 agpl | agpl | agpl
1 0.70 gfdl | gnu free documentation license | gnu free documentation license
1 0.70 mpl | mozilla public license | mozilla public license
1 0.70 epl | eclipse public license | eclipse public license
1 0.70 apache | apache license | apache license
1 0.60 bsd | bsd license | bsd(?: style)? license
1 0.70 artistic | artistic license | artistic license
1 0.70 boost-1.0 | boost software license | boost software license
1 0.70 zlib | zlib license | zlib(?: libpng)? license
1 0.70 postgresql | postgresql | postgresql licen[cs]e
1 0.70 ruby | ruby license | ruby license
1 0.70 php | php license | php license
1 0.70 ofl-1.1 | open font license | (?:sil )?open font license
1 0.70 odbl-1.0 | open database license | open database license
1 0.70 ms-pl | microsoft public license | microsoft public license
1 0.70 ms-rl | microsoft reciprocal license | microsoft reciprocal license
1 0.70 afl-3.0 | academic free license | academic free license
1 0.70 osl-3.0 | open software license | open software license
1 0.70 apsl-2.0 | apple public source license | apple public source license
1 0.70 qpl-1.0 | q public license | q public license
1 0.70 zpl-2.1 | zope public license | zope public license
1 0.70 lppl-1.3 | latex project public license | latex project public license
1 0.70 w3c | w3c software notice license | w3c software notice and license
1 0.70 unicode | unicode license agreement | unicode license agreement
1 0.70 cecill-2.1 | cecill | cecill(?: (?:b|c|2 1))?
1 0.70 mulan-2.0 | mulan psl | mulan psl(?: v2)?
1 0.60 public-domain | public domain | (?:in|into|to) the public domain
1 0.60 commercial | commercial | commercial licen[cs]e
1 0.60 non-commercial | non commercial use | (?:for )?non commercial use only
1 0.60 copyright | copyright reserved | copyright (?:c )?(?:\d{4} )(?:\S+ ){1,8}all rights reserved
1 0.50 copyright | copyright | copyright (?:c )?(?:19|20)\d\d
1 0.50 copyleft | copyleft | copyleft
1 0.60 terms-of-use | subject to terms of | subject to (?:the |our )?terms of (?:use|service)
1 0.60 license-file | see the license file | see the (?:accompanying )?license file
1 0.60 open-source | open source | open source licen[cs]e
"""
