"""The signature rules of the license scan, one a line: label, keyword, pattern, priority, confidence.

Patterns are over lower-case words between single spaces (all signs are spaces there, so ``Apache-2.0`` reads ``apache 2 0``).
A keyword starts a word in every text that its pattern matches. Of two detections of which one lies in the other, the
one of higher priority stays, of equals the longer one, then the earlier rule.
"""

#: The phrases that every result reports, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

RULES = [
    # -- MIT and its kin
    ("mit", "spdx", r"spdx license identifier mit", 90, 1.0),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 85, 0.95),
    ("mit", "the above copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 84, 0.9),
    ("mit", "licensed under", r"licensed under (?:the )?(?:terms of the )?mit(?: license)?", 80, 0.95),
    ("mit", "licenced under", r"licenced under (?:the )?(?:terms of the )?mit(?: licence)?", 80, 0.95),
    ("mit", "released under", r"released under (?:the )?(?:terms of the )?mit licen[cs]e", 80, 0.95),
    ("mit", "distributed under", r"distributed under (?:the )?(?:terms of the )?mit licen[cs]e", 80, 0.95),
    ("mit", "available under", r"available under (?:the )?(?:terms of the )?mit licen[cs]e", 80, 0.95),
    ("mit", "opensource org", r"opensource org licenses? mit(?: license)?(?: php| html)?", 70, 0.95),
    ("mit", "choosealicense", r"choosealicense com licenses mit", 70, 0.9),
    ("mit", "mit", r"mit(?: x11)?(?: open source)? licen[cs]ed?", 60, 0.85),
    ("mit", "license mit", r"license mit", 58, 0.8),
    ("mit", "expat", r"expat licen[cs]e", 60, 0.85),
    ("mit-0", "spdx", r"spdx license identifier mit 0", 91, 1.0),
    ("mit-0", "mit", r"mit (?:no attribution|0)(?: licen[cs]e)?", 61, 0.85),
    ("x11", "spdx", r"spdx license identifier x11", 90, 1.0),
    ("x11", "x11", r"x11 licen[cs]e", 60, 0.8),
    ("x11", "except as contained", r"except as contained in this notice the name of the (?:x consortium|\S+ \S+|\S+) shall not be used in advertising", 85, 0.85),
    ("isc", "spdx", r"spdx license identifier isc", 90, 1.0),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 86, 0.95),
    ("isc", "permission to use", r"permission to use copy modify (?:and|and or) distribute this software for any purpose", 85, 0.85),
    ("isc", "licensed under", r"licensed under (?:the )?isc licen[cs]e", 80, 0.95),
    ("isc", "opensource org", r"opensource org licenses? isc", 70, 0.9),
    ("isc", "isc", r"isc licen[cs]e", 60, 0.85),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose", 85, 0.85),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", 60, 0.85),
    ("0bsd", "spdx", r"spdx license identifier 0bsd", 90, 1.0),
    ("0bsd", "zero clause", r"zero clause bsd(?: licen[cs]e)?", 61, 0.9),
    ("0bsd", "bsd zero", r"bsd zero clause(?: licen[cs]e)?", 61, 0.9),
    # -- BSD
    ("bsd-2-clause", "spdx", r"spdx license identifier bsd 2 clause", 90, 1.0),
    ("bsd-2-clause", "bsd 2", r"bsd 2 clause(?: licen[cs]e)?", 61, 0.9),
    ("bsd-2-clause", "2 clause", r"2 clause bsd(?: licen[cs]e)?", 61, 0.9),
    ("bsd-2-clause", "two clause", r"two clause bsd(?: licen[cs]e)?", 61, 0.9),
    ("bsd-2-clause", "simplified bsd", r"simplified bsd(?: licen[cs]e)?", 61, 0.9),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e", 61, 0.85),
    ("bsd-2-clause", "opensource org", r"opensource org licenses? bsd 2 clause", 71, 0.9),
    ("bsd-3-clause", "spdx", r"spdx license identifier bsd 3 clause", 90, 1.0),
    ("bsd-3-clause", "bsd 3", r"bsd 3 clause(?: licen[cs]e)?", 61, 0.9),
    ("bsd-3-clause", "3 clause", r"3 clause bsd(?: licen[cs]e)?", 61, 0.9),
    ("bsd-3-clause", "three clause", r"three clause bsd(?: licen[cs]e)?", 61, 0.9),
    ("bsd-3-clause", "new bsd", r"new bsd(?: licen[cs]e)?", 61, 0.85),
    ("bsd-3-clause", "modified bsd", r"modified bsd(?: licen[cs]e)?", 61, 0.85),
    ("bsd-3-clause", "revised bsd", r"revised bsd(?: licen[cs]e)?", 61, 0.85),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 86, 0.95),
    ("bsd-3-clause", "opensource org", r"opensource org licenses? bsd 3 clause", 71, 0.9),
    ("bsd-4-clause", "spdx", r"spdx license identifier bsd 4 clause", 90, 1.0),
    ("bsd-4-clause", "all advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 86, 0.95),
    ("bsd-4-clause", "bsd 4", r"bsd 4 clause(?: licen[cs]e)?", 61, 0.9),
    ("bsd-4-clause", "original bsd", r"original bsd(?: licen[cs]e)?", 61, 0.85),
    ("bsd-4-clause", "old bsd", r"old bsd(?: licen[cs]e)?", 61, 0.8),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 85, 0.9),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice", 84, 0.85),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 84, 0.85),
    ("bsd", "licensed under", r"licensed under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[cs]e)?", 80, 0.9),
    ("bsd", "governed by", r"governed by a bsd style licen[cs]e", 80, 0.9),
    ("bsd", "bsd", r"bsd(?: style| like)? licen[cs]ed?", 60, 0.8),
    # -- Apache
    ("apache-2", "spdx", r"spdx license identifier apache 2 0", 90, 1.0),
    ("apache-2", "licensed under", r"licensed under the apache licen[cs]e(?: version 2(?: 0)?)?", 80, 0.95),
    ("apache-2", "released under", r"released under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version)?(?: v?2(?: 0)?)?", 80, 0.95),
    ("apache-2", "distributed under", r"distributed under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version)?(?: v?2(?: 0)?)?", 80, 0.95),
    ("apache-2", "available under", r"available under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version)?(?: v?2(?: 0)?)?", 80, 0.95),
    ("apache-2", "you may not use", r"you may not use this file except in compliance with the licen[cs]e", 79, 0.8),
    ("apache-2", "unless required by", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 85, 0.9),
    ("apache-2", "apache org", r"apache org licenses license 2 0(?: txt| html)?", 72, 0.95),
    ("apache-2", "opensource org", r"opensource org licenses? apache 2 0", 70, 0.9),
    ("apache-2", "apache", r"apache(?: software)?(?: foundation)?(?: public)? licen[cs]e(?: version)?(?: v)? ?v?2(?: 0)?", 61, 0.9),
    ("apache-2", "apache 2", r"apache 2(?: 0)?(?: licen[cs]e)?", 60, 0.8),
    ("apache-2", "asl 2", r"asl 2 0", 58, 0.7),
    ("apache-1.1", "spdx", r"spdx license identifier apache 1 1", 90, 1.0),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 1", 62, 0.9),
    ("apache-1.1", "this product includes", r"this product includes software developed by the apache software foundation", 70, 0.8),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 0", 62, 0.9),
    ("apache", "apache licensed", r"apache licensed", 55, 0.7),
    # -- GPL
    ("gpl-1.0", "spdx", r"spdx license identifier gpl 1 0(?: only| or later)?", 90, 1.0),
    ("gpl-2.0", "spdx", r"spdx license identifier gpl 2 0(?: only| or later)?", 90, 1.0),
    ("gpl-3.0", "spdx", r"spdx license identifier gpl 3 0(?: only| or later)?", 90, 1.0),
    ("gpl-2.0", "gnu general public", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? ?(?:version|v) ?2(?: 0)?", 81, 0.95),
    ("gpl-3.0", "gnu general public", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? ?(?:version|v) ?3(?: 0)?", 81, 0.95),
    ("gpl-1.0", "gnu general public", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? ?(?:version|v) ?1(?: 0)?", 81, 0.95),
    ("gpl", "this program is free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 86, 0.95),
    ("gpl", "free software you", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 85, 0.95),
    ("gpl", "without even the", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", 84, 0.9),
    ("gpl", "you should have", r"you should have received a copy of the gnu general public licen[cs]e", 84, 0.9),
    ("gpl", "licensed under", r"licensed under (?:the )?(?:terms of the )?(?:gnu )?gpl", 80, 0.9),
    ("gpl", "released under", r"released under (?:the )?(?:terms of the )?(?:gnu )?gpl", 80, 0.9),
    ("gpl", "distributed under", r"distributed under (?:the )?(?:terms of the )?(?:gnu )?gpl", 80, 0.9),
    ("gpl", "gnu", r"gnu (?:general public licen[cs]e|gpl)", 60, 0.85),
    ("gpl-2.0", "gpl", r"gpl(?: version)? ?v?2(?: 0)?", 62, 0.85),
    ("gpl-2.0", "gplv2", r"gplv2(?: 0)?", 62, 0.9),
    ("gpl-3.0", "gpl", r"gpl(?: version)? ?v?3(?: 0)?", 62, 0.85),
    ("gpl-3.0", "gplv3", r"gplv3(?: 0)?", 62, 0.9),
    ("gpl", "gpl", r"gpl(?: licen[cs]ed?| compatible)", 58, 0.75),
    ("gpl", "copyleft", r"copyleft licen[cs]e", 40, 0.5),
    ("gpl-2.0", "gnu org", r"gnu org licenses(?: old licenses)? gpl 2 0(?: txt| html)?", 72, 0.95),
    ("gpl-3.0", "gnu org", r"gnu org licenses gpl 3 0(?: txt| html)?", 72, 0.95),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl(?: txt| html)?", 71, 0.9),
    ("classpath-exception", "classpath exception", r"classpath exception(?: 2 0)?", 75, 0.9),
    ("classpath-exception", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 86, 0.95),
    ("gcc-exception", "gcc runtime", r"gcc runtime library exception(?: version)?(?: 3 1)?", 75, 0.9),
    ("font-exception", "font exception", r"font exception(?: to the gpl| 2 0)?", 74, 0.7),
    ("autoconf-exception", "as a special", r"as a special exception to the gnu general public licen[cs]e if you distribute this file as part of a program", 86, 0.9),
    ("bison-exception", "as a special", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 86, 0.95),
    ("openssl-exception", "as a special", r"as a special exception the (?:copyright holders|authors) give permission to link the code (?:\S+ ){0,6}openssl", 86, 0.9),
    ("linux-syscall-note", "linux syscall", r"linux syscall note", 92, 1.0),
    # -- LGPL, AGPL, GFDL
    ("lgpl-2.0", "spdx", r"spdx license identifier lgpl 2 0(?: only| or later)?", 90, 1.0),
    ("lgpl-2.1", "spdx", r"spdx license identifier lgpl 2 1(?: only| or later)?", 90, 1.0),
    ("lgpl-3.0", "spdx", r"spdx license identifier lgpl 3 0(?: only| or later)?", 90, 1.0),
    ("lgpl-2.0", "gnu library", r"gnu library general public licen[cs]e(?: as published by the free software foundation)?(?: either)? ?(?:version|v) ?2(?: 0)?", 82, 0.95),
    ("lgpl-2.1", "gnu lesser", r"gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? ?(?:version|v) ?2 1", 82, 0.95),
    ("lgpl-3.0", "gnu lesser", r"gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)? ?(?:version|v) ?3(?: 0)?", 82, 0.95),
    ("lgpl", "this library is free", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:library|lesser) general public licen[cs]e", 86, 0.95),
    ("lgpl", "you should have", r"you should have received a copy of the gnu (?:library|lesser) general public licen[cs]e", 84, 0.9),
    ("lgpl", "gnu lesser", r"gnu lesser general public licen[cs]e", 63, 0.9),
    ("lgpl", "gnu library", r"gnu library general public licen[cs]e", 63, 0.9),
    ("lgpl", "licensed under", r"licensed under (?:the )?(?:terms of the )?(?:gnu )?lgpl", 80, 0.9),
    ("lgpl-2.1", "lgpl", r"lgpl(?: version)? ?v?2 1", 62, 0.9),
    ("lgpl-3.0", "lgpl", r"lgpl(?: version)? ?v?3(?: 0)?", 62, 0.9),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?", 62, 0.9),
    ("lgpl-3.0", "lgplv3", r"lgplv3", 62, 0.9),
    ("lgpl", "lgpl", r"lgpl(?: licen[cs]ed?)?", 58, 0.75),
    ("lgpl-2.1", "gnu org", r"gnu org licenses(?: old licenses)? lgpl 2 1(?: txt| html)?", 72, 0.95),
    ("lgpl-3.0", "gnu org", r"gnu org licenses lgpl(?: 3 0)?(?: txt| html)?", 72, 0.9),
    ("agpl-3.0", "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?", 90, 1.0),
    ("agpl-3.0", "gnu affero", r"gnu affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)? ?(?:version|v) ?3(?: 0)?", 82, 0.95),
    ("agpl-3.0", "gnu affero", r"gnu affero general public licen[cs]e", 63, 0.9),
    ("agpl-3.0", "affero", r"affero general public licen[cs]e(?: version)?(?: 3(?: 0)?)?", 62, 0.9),
    ("agpl-3.0", "agpl", r"agpl(?: version)? ?v?3(?: 0)?", 62, 0.9),
    ("agpl-3.0", "agplv3", r"agplv3", 62, 0.9),
    ("agpl-3.0", "gnu org", r"gnu org licenses agpl(?: 3 0)?(?: txt| html)?", 72, 0.95),
    ("gfdl-1.2", "spdx", r"spdx license identifier gfdl 1 2(?: only| or later)?", 90, 1.0),
    ("gfdl-1.3", "spdx", r"spdx license identifier gfdl 1 3(?: only| or later)?", 90, 1.0),
    ("gfdl-1.2", "gnu free", r"gnu free documentation licen[cs]e(?: version)? 1 2", 62, 0.95),
    ("gfdl-1.3", "gnu free", r"gnu free documentation licen[cs]e(?: version)? 1 3", 62, 0.95),
    ("gfdl", "gnu free", r"gnu free documentation licen[cs]e", 60, 0.9),
    ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 86, 0.95),
    # -- Mozilla, Eclipse, IBM, Sun
    ("mpl-1.1", "spdx", r"spdx license identifier mpl 1 1", 90, 1.0),
    ("mpl-2.0", "spdx", r"spdx license identifier mpl 2 0", 90, 1.0),
    ("mpl-2.0", "this source code", r"this source code form is subject to the terms of the mozilla public licen[cs]e v ?2 0", 86, 0.95),
    ("mpl-1.1", "the contents of", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 86, 0.95),
    ("mpl-1.0", "the contents of", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 0", 86, 0.95),
    ("mpl-1.1", "mozilla public", r"mozilla public licen[cs]e(?: version)? ?v?1 1", 62, 0.9),
    ("mpl-2.0", "mozilla public", r"mozilla public licen[cs]e(?: version)?(?: ?v?2(?: 0)?)?", 61, 0.85),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0", 72, 0.95),
    ("mpl-2.0", "mpl", r"mpl ?v?2(?: 0)?", 58, 0.8),
    ("epl-1.0", "spdx", r"spdx license identifier epl 1 0", 90, 1.0),
    ("epl-2.0", "spdx", r"spdx license identifier epl 2 0", 90, 1.0),
    ("epl-1.0", "eclipse public", r"eclipse public licen[cs]e(?: version)?(?: ?v?1(?: 0)?)?", 61, 0.85),
    ("epl-2.0", "eclipse public", r"eclipse public licen[cs]e(?: version)? ?v?2(?: 0)?", 62, 0.9),
    ("epl-1.0", "eclipse org", r"eclipse org legal epl v10(?: html)?", 72, 0.95),
    ("epl-2.0", "eclipse org", r"eclipse org legal epl (?:2 0|v20)(?: html)?", 72, 0.95),
    ("edl-1.0", "eclipse distribution", r"eclipse distribution licen[cs]e(?: version)?(?: ?v?1(?: 0)?)?", 61, 0.9),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: version)?(?: 1 0)?", 60, 0.85),
    ("cpal-1.0", "common public", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?", 62, 0.9),
    ("cddl-1.0", "spdx", r"spdx license identifier cddl 1 0", 90, 1.0),
    ("cddl-1.1", "spdx", r"spdx license identifier cddl 1 1", 90, 1.0),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: version)?(?: 1 0)?", 61, 0.9),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e(?: version)? 1 1", 62, 0.95),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: version)?(?: 1 0)?", 60, 0.9),
    ("spl-1.0", "sun public", r"sun public licen[cs]e(?: version)?(?: 1 0)?", 60, 0.9),
    ("netscape", "netscape public", r"netscape public licen[cs]e(?: version)?(?: 1 [01])?", 60, 0.9),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: version)?(?: ?v?3(?: 0)?)?", 60, 0.85),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: version)?(?: ?v?3(?: 0)?)?", 60, 0.85),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: version)?(?: ?v?1 0)?", 60, 0.9),
    # -- Creative Commons
    ("cc0-1.0", "spdx", r"spdx license identifier cc0 1 0", 90, 1.0),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 72, 0.95),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", 62, 0.9),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 61, 0.85),
    ("cc0-1.0", "has waived all", r"has waived all copyright and related or neighbou?ring rights", 85, 0.85),
    ("cc-by", "spdx", r"spdx license identifier cc by [1-4] [05]", 90, 1.0),
    ("cc-by-sa", "spdx", r"spdx license identifier cc by sa [1-4] [05]", 90, 1.0),
    ("cc-by-nd", "spdx", r"spdx license identifier cc by nd [1-4] [05]", 90, 1.0),
    ("cc-by-nc", "spdx", r"spdx license identifier cc by nc [1-4] [05]", 90, 1.0),
    ("cc-by-nc-sa", "spdx", r"spdx license identifier cc by nc sa [1-4] [05]", 90, 1.0),
    ("cc-by-nc-nd", "spdx", r"spdx license identifier cc by nc nd [1-4] [05]", 90, 1.0),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1-4] [05]", 72, 0.95),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1-4] [05]", 72, 0.95),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1-4] [05]", 72, 0.95),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1-4] [05]", 72, 0.95),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [05]", 72, 0.95),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [05]", 72, 0.95),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", 60, 0.8),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", 61, 0.85),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", 61, 0.85),
    ("cc-by-nc", "cc by", r"cc by nc [1-4] [05]", 61, 0.85),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", 62, 0.9),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", 62, 0.9),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?", 61, 0.85),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?", 62, 0.9),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative|atives|s|ativeworks)(?: [1-4] [05])?", 62, 0.9),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?", 62, 0.9),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", 63, 0.9),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative|atives|s|ativeworks)(?: [1-4] [05])?", 63, 0.9),
    ("cc", "some rights", r"some rights reserved", 40, 0.5),
    ("cc", "creative commons", r"creative commons licen[cs]e", 50, 0.6),
    # -- public domain and the like
    ("unlicense", "spdx", r"spdx license identifier unlicense", 90, 1.0),
    ("unlicense", "this is free and", r"this is free and unencumbered software released into the public domain", 86, 0.95),
    ("unlicense", "unlicense org", r"unlicense org", 70, 0.9),
    ("unlicense", "unlicense", r"unlicense", 55, 0.8),
    ("wtfpl", "do what the", r"do what the fuck you want to public licen[cs]e", 86, 0.95),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", 60, 0.9),
    ("beerware", "beer ware", r"beer ware licen[cs]e(?: revision 42)?", 61, 0.9),
    ("beerware", "beerware", r"beerware(?: licen[cs]e)?", 60, 0.85),
    ("public-domain", "released into", r"released into the public domain", 50, 0.8),
    ("public-domain", "dedicated to", r"dedicated to the public domain", 50, 0.8),
    ("public-domain", "placed in", r"placed in the public domain", 50, 0.8),
    ("public-domain", "in the public domain", r"in the public domain", 48, 0.7),
    ("public-domain", "public domain dedication", r"public domain dedication", 50, 0.75),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e(?: ?v?1 0)?", 61, 0.9),
    ("odbl-1.0", "open database", r"open database licen[cs]e(?: ?v?1 0)?", 61, 0.9),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?", 60, 0.85),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: ?v?1 0)?", 61, 0.9),
    ("ogl-3.0", "open government", r"open government licen[cs]e(?: ?v?3 0)?", 60, 0.85),
    ("crown-copyright", "crown copyright", r"crown copyright", 45, 0.7),
    # -- other licences for software, fonts and data
    ("zlib", "spdx", r"spdx license identifier zlib", 90, 1.0),
    ("zlib", "this software is provided", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 86, 0.95),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 85, 0.95),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 60, 0.9),
    ("libpng", "libpng", r"libpng licen[cs]e", 60, 0.9),
    ("bsl-1.0", "spdx", r"spdx license identifier bsl 1 0", 90, 1.0),
    ("bsl-1.0", "distributed under", r"distributed under the boost software licen[cs]e(?: version)?(?: 1 0)?", 80, 0.95),
    ("bsl-1.0", "boost software", r"boost software licen[cs]e(?: version)?(?: 1 0)?", 60, 0.9),
    ("bsl-1.0", "boost org", r"boost org license 1 0(?: txt)?", 72, 0.95),
    ("busl-1.1", "spdx", r"spdx license identifier busl 1 1", 90, 1.0),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: version)?(?: 1 1)?", 60, 0.9),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: version)?(?: 1(?: 0)?)?", 60, 0.8),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? 2(?: 0)?", 61, 0.9),
    ("perl", "same terms as perl", r"same terms as perl(?: itself)?", 65, 0.85),
    ("python", "python software", r"python software foundation licen[cs]e(?: version)?(?: 2)?", 60, 0.9),
    ("python", "psf", r"psf licen[cs]e", 58, 0.8),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", 60, 0.9),
    ("php-3.01", "php", r"php licen[cs]e(?: version)?(?: ?v?3 01)?", 60, 0.9),
    ("ruby", "ruby", r"ruby(?: s)? licen[cs]e", 60, 0.8),
    ("vim", "vim", r"vim licen[cs]e", 60, 0.85),
    ("openssl", "openssl", r"openssl licen[cs]e", 60, 0.9),
    ("openssl", "this product includes", r"this product includes software developed by the openssl project", 70, 0.85),
    ("ncsa", "ncsa", r"ncsa(?: open source)? licen[cs]e", 60, 0.9),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", 60, 0.9),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", 60, 0.9),
    ("eupl-1.1", "european union", r"european union public licen[cs]e(?: version)? ?v?1 1", 61, 0.9),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: version)?(?: ?v?1 2)?", 60, 0.9),
    ("eupl-1.2", "eupl", r"eupl(?: v?1 2)?", 58, 0.85),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version)?(?: 2 1)?", 60, 0.85),
    ("ofl-1.1", "spdx", r"spdx license identifier ofl 1 1", 90, 1.0),
    ("ofl-1.1", "sil open", r"sil open font licen[cs]e(?: version)?(?: 1 1)?", 61, 0.95),
    ("ofl-1.1", "open font", r"open font licen[cs]e(?: version)?(?: 1 1)?", 60, 0.9),
    ("qpl-1.0", "q public", r"q public licen[cs]e(?: version)?(?: 1 0)?", 60, 0.9),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?: version)?(?: ?v?1)?", 60, 0.9),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: version)?(?: ?v?2(?: 0)?)?", 60, 0.9),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?", 62, 0.9),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e(?: version)?(?: \d \d)?", 60, 0.9),
    ("json", "the software shall", r"the software shall be used for good not evil", 86, 0.95),
    ("json", "json", r"json licen[cs]e", 58, 0.8),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict)(?: licen[cs]e)?(?: 1 0 0)?", 61, 0.9),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", 60, 0.85),
    ("openrail", "responsible ai", r"responsible ai licen[cs]e", 58, 0.8),
    ("blue-oak-1.0.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?", 60, 0.9),
    ("tmate", "tmate", r"tmate open source licen[cs]e", 60, 0.9),
    # -- fields of package files, and identifiers not named above
    ("apache-2", "license apache", r"license apache 2(?: 0)?", 62, 0.9),
    ("bsd-3-clause", "license bsd", r"license bsd 3 clause", 62, 0.9),
    ("bsd-2-clause", "license bsd", r"license bsd 2 clause", 62, 0.9),
    ("bsd", "license bsd", r"license bsd", 59, 0.8),
    ("gpl", "license gpl", r"license gpl(?:v[23])?", 59, 0.8),
    ("lgpl", "license lgpl", r"license lgpl(?:v[23])?", 59, 0.8),
    ("isc", "license isc", r"license isc", 59, 0.8),
    ("cc-by", "this work is", r"this work is licensed under a creative commons attribution(?: [1-4] [05])?", 81, 0.95),
    ("cc-by-sa", "this work is", r"this work is licensed under a creative commons attribution share ?alike(?: [1-4] [05])?", 82, 0.95),
    ("cc-by-nc", "this work is", r"this work is licensed under a creative commons attribution non ?commercial(?: [1-4] [05])?", 82, 0.95),
    ("wtfpl", "spdx", r"spdx license identifier wtfpl", 90, 1.0),
    ("postgresql", "spdx", r"spdx license identifier postgresql", 90, 1.0),
    ("python", "spdx", r"spdx license identifier (?:python|psf) 2 0(?: 1)?", 90, 1.0),
    ("artistic-2.0", "spdx", r"spdx license identifier artistic 2 0", 90, 1.0),
    ("ncsa", "spdx", r"spdx license identifier ncsa", 90, 1.0),
    ("ms-pl", "spdx", r"spdx license identifier ms pl", 90, 1.0),
    ("ms-rl", "spdx", r"spdx license identifier ms rl", 90, 1.0),
    ("upl-1.0", "spdx", r"spdx license identifier upl 1 0", 90, 1.0),
    ("eupl-1.2", "spdx", r"spdx license identifier eupl 1 2", 90, 1.0),
    ("osl-3.0", "spdx", r"spdx license identifier osl 3 0", 90, 1.0),
    ("afl-3.0", "spdx", r"spdx license identifier afl 3 0", 90, 1.0),
    ("vim", "spdx", r"spdx license identifier vim", 90, 1.0),
    ("ruby", "spdx", r"spdx license identifier ruby", 90, 1.0),
    ("php-3.01", "spdx", r"spdx license identifier php 3 01", 90, 1.0),
    ("sspl-1.0", "spdx", r"spdx license identifier sspl 1 0", 90, 1.0),
    ("elastic-2.0", "spdx", r"spdx license identifier elastic 2 0", 90, 1.0),
    ("odbl-1.0", "spdx", r"spdx license identifier odbl 1 0", 90, 1.0),
    ("beerware", "spdx", r"spdx license identifier beerware", 90, 1.0),
    ("blue-oak-1.0.0", "spdx", r"spdx license identifier blueoak 1 0 0", 90, 1.0),
    # -- notices that name no licence
    ("all-rights-reserved", "all rights", r"(?:copyright (?:c )?(?:\d{4} )?(?:\S+ ){0,4})?all rights reserved", 40, 0.7),
    ("all-rights-reserved", "no part of this", r"no part of this (?:publication|document|book|work) may be reproduced", 45, 0.8),
    ("proprietary", "proprietary and", r"proprietary and confidential", 46, 0.8),
    ("proprietary", "confidential and", r"confidential and proprietary", 46, 0.8),
    ("proprietary", "proprietary licen", r"proprietary licen[cs]e", 45, 0.75),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", 46, 0.8),
    ("proprietary", "unauthorised", r"unauthorised (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", 46, 0.8),
    ("proprietary", "trade secret", r"trade secrets? of", 38, 0.5),
    ("no-commercial-use", "not for", r"not for commercial use", 42, 0.7),
    ("no-commercial-use", "for non", r"for non ?commercial (?:use|purposes) only", 43, 0.75),
    ("no-commercial-use", "no commercial", r"no commercial use", 41, 0.65),
    ("no-commercial-use", "personal use only", r"personal use only", 40, 0.6),
    ("research-only", "for research", r"for research (?:use|purposes) only", 43, 0.7),
    ("evaluation-only", "for evaluation", r"for evaluation (?:use|purposes) only", 43, 0.7),
    ("eula", "end user licen", r"end user licen[cs]e agreement", 45, 0.7),
    ("as-is", "provided as is", r"provided as is without (?:any |express or implied )?warrant(?:y|ies)", 30, 0.4),
    ("as-is", "without warranty", r"without warranty of any kind", 30, 0.4),
    ("copyright", "copyright", r"copyright (?:c )?\d{4}", 20, 0.4),
    ("license-file", "see the licen", r"see the licen[cs]e file", 25, 0.4),
    ("license-file", "license file", r"license file for (?:details|more information)", 25, 0.4),
    ("dual-license", "dual", r"dual(?:ly)? licen[cs]ed", 35, 0.5),
    ("open-source", "open source licen", r"open source licen[cs]e", 22, 0.3),
]

#: A document is looked at further if its lower-case words hold one of these; every text that a rule matches does.
GATE = (
    "licen", "copyright", "copyleft", "rights reserved", "public domain", "permission", "redistribution", "hereby granted", "free software", "proprietary", "warrant", "bsd", "gpl", " gnu ", "apache", "asl 2 0", "mozilla", " mpl",
    "eclipse org", "creativecommons", "creative commons", "cc by", "cc0", "mit no attribution", " mit 0 ", "wtfpl", "beerware", "odbl", "eupl", "cecill", "openrail", "polyform", "commons clause", "classpath exception", "font exception",
    "library exception", "syscall note", "special exception", "library statically", "source code form", "terms as perl", "good not evil", "altered source", "advertising", "to endorse or promote", "this product includes", "commercial",
    "personal use only", "for research", "for evaluation", "no part of this", "trade secret", "unauthori", "provided as is",
)
