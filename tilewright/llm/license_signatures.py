"""Signatures written by hand from the texts, headers and notices of licenses.

(keyword, regex over words, label, priority, confidence), as ``license_scan`` reads them. A keyword
stands in every text that its regex matches. Fixed values: the wordings of published licenses.
"""

from __future__ import annotations

SIGNATURES: list[tuple[str, str, str, int, float]] = [
    # Apache
    ("licensed under the apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0", 3, 1.0),
    ("apache org licenses", r"you may obtain a copy of the license at https? www apache org licenses license 2 0", "apache-2.0", 3, 0.98),
    ("apache org licenses", r"www apache org licenses license 1 1", "apache-1.1", 3, 0.95),
    ("limitations under the license", r"see the license for the specific language governing permissions and limitations under the license", "apache-2.0", 2, 0.75),
    ("apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2.0", 3, 0.98),
    ("apache software foundation", r"this product includes software developed by the apache software foundation", "apache-1.1", 3, 0.8),
    # MIT and its kin
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit", 3, 1.0),
    ("substantial portions of the software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 3, 0.95),
    ("dealings in the software", r"arising from out of or in connection with the software or the use or other dealings in the software", "mit", 2, 0.9),
    ("good not evil", r"the software shall be used for good not evil", "json", 3, 0.99),
    ("x consortium", r"the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings", "x11", 3, 0.98),
    ("permission is hereby granted without written agreement", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute", "mit-modern-variant", 3, 0.95),
    ("permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", "hpnd", 3, 0.95),
    ("suitability of this software", r"makes no representations about the suitability of this software for any purpose it is provided as is without express or implied warranty", "ntp", 2, 0.85),
    ("with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc", 3, 1.0),
    ("with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "0bsd", 3, 0.99),
    # BSD
    ("redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", 3, 0.97),
    ("redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd", 3, 0.97),
    ("endorse or promote products", r"may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause", 3, 0.95),
    ("by the regents of the university", r"copyright (?:c )?\d+ by the regents of the university", "bsd", 2, 0.85),
    ("the following acknowledgement", r"must display the following acknowledgement this product includes software developed by", "bsd-4-clause", 3, 0.98),
    ("no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license", "bsd-3-clause-clear", 2, 0.7),
    # GNU
    ("free software foundation", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", 4, 0.99),
    ("free software foundation", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", "lgpl", 4, 0.99),
    ("affero general public", r"under the terms of the gnu affero general public license as published by the free software foundation", "agpl", 4, 0.99),
    ("general public license for more details", r"see the gnu (?:lesser |library |affero )?general public license for more details", "gpl", 2, 0.8),
    ("a copy of the gnu", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library)", "gpl", 3, 0.9),
    ("free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 3, 0.99),
    ("invariant sections", r"with no invariant sections no front cover texts and no back cover texts", "gfdl", 3, 0.95),
    ("version 2 of the license", r"either version 2 of the license or at your option any later version", "gpl-2.0-or-later", 3, 0.9),
    ("version 3 of the license", r"either version 3 of the license or at your option any later version", "gpl-3.0-or-later", 3, 0.9),
    ("version 2 1 of the license", r"either version 2 1 of the license or at your option any later version", "lgpl-2.1-or-later", 3, 0.95),
    ("classpath exception", r"(?:subject to the |gnu |with )classpath exception", "gpl-with-classpath-exception", 2, 0.9),
    ("special exception", r"as a special exception (?:the copyright holders|you may|to the gnu)", "gpl-with-exception", 2, 0.7),
    ("gcc runtime library exception", r"gcc runtime library exception", "gpl-with-gcc-exception", 2, 0.9),
    ("take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it", "gpl", 2, 0.6),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", 4, 1.0),
    ("mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl 2 0", "mpl-2.0", 3, 0.95),
    ("subject to the mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 4, 1.0),
    ("netscape public license", r"netscape public license(?: version 1 \d)?", "npl", 2, 0.9),
    ("accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", 3, 0.98),
    ("eclipse org legal epl", r"www eclipse org legal epl v10", "epl-1.0", 3, 0.97),
    ("eclipse org legal epl", r"www eclipse org legal epl 2 0", "epl-2.0", 3, 0.97),
    ("common development and distribution license", r"subject to the terms of the common development and distribution license", "cddl", 3, 0.98),
    ("cddl", r"(?:dual licensed under cddl|cddl header start)", "cddl", 3, 0.9),
    ("european union public licence", r"european union public licence", "eupl", 2, 0.9),
    ("cecill", r"cecill(?: b| c| 2 0| 2 1)?", "cecill", 2, 0.85),
    ("qt public license", r"(?:the )?qt public license", "qpl", 2, 0.85),
    ("sleepycat", r"sleepycat (?:license|software)", "sleepycat", 2, 0.85),
    # Boost, zlib, libraries and languages
    ("boost software license", r"distributed under the boost software license version 1 0", "bsl-1.0", 3, 1.0),
    ("boost org license 1 0", r"www boost org license 1 0 txt", "bsl-1.0", 3, 0.97),
    ("origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", 3, 0.99),
    ("altered source versions", r"altered source versions must be plainly marked as such", "zlib", 3, 0.95),
    ("independent jpeg group", r"this software is based in part on the work of the independent jpeg group", "ijg", 3, 0.95),
    ("openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 3, 0.99),
    ("cryptographic software written by eric young", r"this product includes cryptographic software written by eric young", "ssleay", 3, 0.97),
    ("python software foundation license", r"python software foundation license version 2", "psf-2.0", 3, 0.95),
    ("beopen python", r"beopen python open source license agreement", "python-2.0", 3, 0.95),
    ("this product includes php", r"this product includes php software freely available from", "php-3.01", 3, 0.97),
    ("same terms as perl", r"(?:under the |on the )?same terms as perl(?: itself)?", "artistic-1.0-perl", 2, 0.9),
    ("same terms as ruby", r"(?:under the |on the )?same terms as ruby", "ruby", 2, 0.85),
    ("a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied", "artistic-1.0", 3, 0.9),
    ("sil open font license", r"this font software is licensed under the sil open font license version 1 1", "ofl-1.1", 3, 1.0),
    ("reserved font name", r"with reserved font names?", "ofl", 2, 0.85),
    ("bitstream vera", r"bitstream vera (?:fonts? copyright|is a trademark)", "bitstream-vera", 2, 0.9),
    ("ubuntu font licence", r"ubuntu font licence(?: version 1 0)?", "ubuntu-font-1.0", 2, 0.9),
    ("unicode inc license", r"unicode inc license agreement data files and software", "unicode-dfs", 3, 0.97),
    ("w3c software", r"w3c software (?:and document )?(?:notice and )?license", "w3c", 2, 0.9),
    ("curl license", r"curl license", "curl", 2, 0.8),
    # Creative Commons and data
    ("creativecommons org licenses by", r"(?:https? )?creativecommons org licenses by 4 0", "cc-by-4.0", 3, 0.97),
    ("creativecommons org licenses by sa", r"(?:https? )?creativecommons org licenses by sa 4 0", "cc-by-sa-4.0", 3, 0.97),
    ("creativecommons org licenses by nc", r"(?:https? )?creativecommons org licenses by nc 4 0", "cc-by-nc-4.0", 3, 0.97),
    ("creativecommons org publicdomain zero", r"(?:https? )?creativecommons org publicdomain zero 1 0", "cc0-1.0", 3, 0.97),
    ("creativecommons org publicdomain mark", r"creativecommons org publicdomain mark 1 0", "public-domain", 3, 0.9),
    ("waived all copyright", r"ha(?:s|ve) waived all copyright and related or neighboring rights", "cc0-1.0", 3, 0.97),
    ("to view a copy of this license", r"to view a copy of this license visit https? creativecommons org", "cc-link", 2, 0.85),
    ("some rights reserved", r"some rights reserved", "some-rights-reserved", 1, 0.4),
    ("open database license", r"made available under the open database license", "odbl", 3, 0.97),
    ("opendatacommons org", r"opendatacommons org licenses odbl", "odbl", 3, 0.95),
    ("opendatacommons org", r"opendatacommons org licenses by", "odc-by", 3, 0.95),
    ("opendatacommons org", r"opendatacommons org licenses pddl", "pddl", 3, 0.95),
    ("open government licence", r"open government licence(?: v ?\d 0)?", "ogl", 2, 0.9),
    ("community data license agreement", r"community data license agreement (?:permissive|sharing)", "cdla", 2, 0.9),
    # Public domain and short jokes that are licenses
    ("free and unencumbered software", r"this is free and unencumbered software", "unlicense", 3, 0.95),
    ("anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 3, 0.97),
    ("into the public domain", r"hereby (?:place|release|dedicate)s? this (?:work|software|code|file) into the public domain", "public-domain", 3, 0.95),
    ("disclaims copyright", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", "blessing", 3, 0.99),
    ("beer ware license", r"the beer ware license(?: revision 42)?", "beerware", 3, 0.97),
    ("buy me a beer", r"you can buy me a beer in return", "beerware", 3, 0.95),
    ("everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl", 2, 0.7),
    ("copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "fsfap", 3, 0.97),
    # Source-available and closed
    ("business source license", r"use of this software is governed by the business source license", "busl-1.1", 3, 0.95),
    ("commons clause", r"commons clause license condition", "commons-clause", 3, 0.9),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license", "polyform", 3, 0.95),
    ("server side public license", r"subject to the terms of the server side public license", "sspl-1.0", 3, 0.97),
    ("non commercial", r"for non commercial (?:use|purposes|research) only", "non-commercial", 2, 0.7),
    ("academic use only", r"(?:for )?(?:research and )?academic use only", "academic-only", 2, 0.75),
    ("end user license agreement", r"end user license agreement", "eula", 2, 0.7),
    ("trade secret", r"(?:contains|is a) trade secrets? of", "proprietary", 2, 0.8),
    ("without the express written", r"may not be (?:copied|reproduced|used|distributed) without the express written (?:permission|consent)", "proprietary", 2, 0.8),
    ("no part of this", r"no part of this (?:publication|work|book|document) may be reproduced", "all-rights-reserved", 2, 0.8),
    ("not for redistribution", r"(?:internal use only )?not for redistribution", "proprietary", 2, 0.75),
    ("u s government restricted rights", r"u s government restricted rights", "proprietary", 2, 0.7),
    # Responsible-use licenses of models
    ("openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?", "openrail", 2, 0.85),
    ("community license agreement", r"llama (?:2 |3 |3 1 )?community license agreement", "llama-community", 2, 0.85),
]
