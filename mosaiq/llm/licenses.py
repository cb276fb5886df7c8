"""Licence scans by canonical digest.

A text is made canonical (ASCII lower case, copyright lines out, all but letters and digits to single spaces, equivalent
spellings to one) and its SHA-256 is joined to the digests of known licence texts; the known table is a constant of
this module, so it is broadcast. Each line that may be a licence notice is looked up by itself in the same way.
Everything is an expression over one row; nothing is shuffled.

Defined cases: null and empty texts have the digest of the empty text and no licence; null ids are carried; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known digests up to which they are broadcast: about 10 MB.
BROADCAST_DIGESTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of copyright, and spellings that count as one.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n(©]*(copyright[ \t]*(\(c\)|[0-9]{4}|<|\[)|copyright[ \t][^\n]*[ \t,-](19|20)[0-9]{2}|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("wilful", "willful"),
    ("whilst", "while"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
    ("creative commons attribution", "cc by"),
    ("noncommercial", "nc"),
)
#: Known licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: The third clause stands after the second one; the names in it that templates have.
_SECOND = "other materials provided with the distribution.\n"
_HOLDERS = ("the copyright holder", "the copyright holders", "the University", "the organization", "the author", "the authors", "the <organization>")
BSD3 = {h: TEXTS["BSD-2-Clause"].replace(_SECOND, f"{_SECOND}3. Neither the name of {h} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n") for h in _HOLDERS}
TEXTS["BSD-3-Clause"] = BSD3["the copyright holder"]
#: Titles that stand over a text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License", '"Simplified BSD License"'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
}
#: Digests of the canonical forms of long texts, as they are distributed, with and without what follows the
#: terms. A text doesn't say whether later versions hold, so the GNU ones have the version alone.
DIGESTS = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25",
        "6df86d8a2cfe223d6d0bacefbfeff6b07e4861587bf8be1a31dcad87a1581967",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
        "a1e8b9f20822fe60589e4d83bee888321a8604b4e4b384c29e0b741b1b096c54",
        "2fc54405737c64959b7f6b3252608508421c0d10ccafd3852e78e1b48685e104",
    ),
    "CC0-1.0": (
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
        "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a",
    ),
    "GPL-1.0": (
        "efd868a36055ab4add714a45bd15a1b1b817c462c241e8303023daae48e868c9",
        "5c47fb5ed4016147baafb020e771d4eb71adefcb6426d6277ea83c2392ad638b",
        "2ff62d187f4b86c4c8141ca55213342149784afbac28947615d15cd4a26f90fd",
    ),
    "GPL-2.0": (
        "76a6eea9a03c0408554f9c38efcf1d997fa25b29d14cd2cebb5240975831c64a",
        "a4c1af503df28392beebaffd59903e3701998c8adb25f5d46a8fbb8edfb41996",
        "f91a71390edc9bdbc94fa84018b5a602e9e2877af986d41579b68c668575495e",
        "c5d2fff6d18e5582c37950f81bef044b779dbe46bda33410eb6d44e3123d5cba",
        "a07b31e413f005893efb82b73c1664077ccbad48a65bc01513dcfdc8af30d965",
        "6682f0d9a5f2b5772c3fa93592f1011da82ec1b9dc4babcf73f7959ac7614e5b",
        "c18a2213648175dc1fe18ade62eaf43b16f912b9fe72922d8b6001e32baf3ee1",
        "f9f7f8062a755897228ce61a93dd0a3fce756f6898b0e0915409bebb12f97507",
        "cf072b2e586dde024f4be274478702e60c34af212cb3e1342a008847f00c6d23",
        "f24db77a8d05d59b799deb0b4afa2e11aad452bfe18855491c7159ff75ef167f",
        "58f3f5329d2868344966b4819d7e9300e7ca5e7668d5aa4e3b08c66c202bcf63",
        "6c725ba4e081d9b7d42120fd0c746e8c01c2e1f4911aab3ed8211f361c811b82",
    ),
    "GPL-3.0": (
        "8263570d1c9d6212087b690bb43cdf0e044a1324f408511bfde4d1b91273f4d7",
        "3b9749f695cb12d8c320c6a897b0f436c498ce7987dbc1c810319898a6fe7a21",
        "464df2bf7300d893ecfd4471f3401c2fc44d4d7e285734e90513449183e5389a",
        "4bf39ef397c06a5fc705d7bd3b5d97a02c71d84fd48d5b9912d22edb0cc936ee",
        "4ad258985010992fa577103ef0f0956df762a8d930f9d8d018fabe328925165d",
        "2235ea4c711d8a21af12547ddec552ecbd2cde412e79485c5f4b12e5ca1d3899",
        "d1ac90282d2fbca19a5821425bfa8c7e3d1416497f4f9dbdacf67e1b7b4e62e9",
    ),
    "LGPL-2.0": (
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "0e3c184176a70698802350b8f697a92e908601a66f8f622e8d4c08c9e90e0a8f",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    ),
    "LGPL-2.1": (
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4f163e21ac81a5bb5b92c19ede75a32428e1338af052850b5a7c1162f56ca800",
        "e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    ),
    "MPL-2.0": (
        "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
        "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de",
    ),
    "Unlicense": (
        "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd",
        "e6e60d2037efe58841d698b341a609d8a738effceaadb12ac721e54f8e0bf7db",
        "d623434f4b1da91fd436ac1ec242349f11506d3a12f61ff9927c6e49a73c671b",
    ),
}
#: Headers of several lines or paragraphs, which may be whole texts.
_APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_FSF = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301"


def _gnu_headers() -> dict[str, list[tuple[str, ...]]]:
    """Licence to the headers of GNU licences, by paragraph: grant, warranty, copy."""
    out: dict[str, list[tuple[str, ...]]] = {}
    for short, name, versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
        full = f"GNU {name}General Public License"
        for version in versions:
            for later in (True, False):
                which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
                for what in ("program", "library", "software", "file"):
                    grant = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation{', ' if later else '; '}{which}."
                    no = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details."
                    ends = ("see <http://www.gnu.org/licenses/>.", f"write to the Free Software Foundation, Inc., {_FSF} USA", f"write to the Free Software Foundation, Inc., {_FSF}, USA.")
                    copies = [f"You should have received a copy of the {full} along with this {what}. If not, {end}" for end in ends]
                    out.setdefault(f"{short}-{version if '.' in version else version + '.0'}-{'or-later' if later else 'only'}", []).extend((grant, no, c) for c in copies)
    return out


GNU_HEADERS = _gnu_headers()
HEADERS = {
    "Apache-2.0": (f'Licensed under the Apache License, Version 2.0 (the "License");\n{_APACHE}', f'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License");\n{_APACHE}'),
    "MPL-2.0": (_MPL,),
    **{k: tuple("\n".join(h[:n]) for h in hs for n in (1, 2, 3)) for k, hs in GNU_HEADERS.items()},
}
#: Ids of SPDX lines. Canonical forms have no "+", so the old GNU ids, with or without it, give the version alone.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "EPL-1.0", "EPL-2.0", "EUPL-1.2",
    "GFDL-1.2-only", "GFDL-1.2-or-later", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PSF-2.0", "PostgreSQL", "Unlicense", "WTFPL", "Zlib",
)
#: Notices of one line.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "The ASF licenses this file to You under the Apache License, Version 2.0",
        'to you under the Apache License, Version 2.0 (the "License");',
        "to you under the Apache License, Version 2.0 (the",
    ),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.",),
    "MPL-2.0": (_MPL, "License, v. 2.0. If a copy of the MPL was not distributed with this", "License, v. 2.0. If a copy of the MPL was not distributed with this file,"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.",),
}
for _k, _hs in GNU_HEADERS.items():
    NOTICES[_k] = (*NOTICES.get(_k, ()), *dict.fromkeys(h[0] for h in _hs))
for _k in SPDX:
    NOTICES[_k] = (*NOTICES.get(_k, ()), f"SPDX-License-Identifier: {_k}")
#: Every notice holds one of these, so only such lines are made canonical.
NOTICE_HINT = r"[lL][iI][cC][eE][nN][cCsS]"


def canonical_text(text: str) -> str:
    """The canonical form, in plain Python; canonical() is the same as an expression."""
    t = text.translate(str.maketrans(UPPER, LOWER))
    t = re.sub(COPYRIGHT_LINE, r"\1", t)
    t = f" {re.sub(r'[^a-z0-9]+', ' ', t).strip(' ')} "
    for a, b in SPELLINGS:
        t = t.replace(f" {a}", f" {b}")
    return t.strip(" ")


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "$1")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a}"), F.lit(f" {b}"))
    return F.trim(t)


def known_licenses() -> dict[str, str]:
    """Digest to licence."""
    texts = [(t, k) for k, t in TEXTS.items()] + [(t, "BSD-3-Clause") for t in BSD3.values()]
    texts += [(f"{title}\n\n{t}", k) for t, k in texts for title in TITLES.get(k, ())]
    pairs = texts + [(t, k) for of in (HEADERS, NOTICES) for k, ts in of.items() for t in ts]
    return {d: k for k, ds in DIGESTS.items() for d in ds} | {hashlib.sha256(canonical_text(t).encode()).hexdigest(): k for t, k in pairs}


def license_scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_digest, license (of the whole text, else null) and notices (licences of its lines, sorted, comma-joined)."""
    known = known if known is not None else known_licenses()
    table = docs.sparkSession.createDataFrame(sorted(known.items()), "_digest string, license string")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    of = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values())))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOTICE_HINT))
    found = F.transform(lines, lambda x: F.try_element_at(of, F.sha2(canonical(x), 256)))
    notices = F.when(text.rlike(NOTICE_HINT), F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda k: k.isNotNull()))), ",")).otherwise("")
    hashed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.sha2(canonical(text), 256).alias("text_digest"), notices.alias("notices"))
    table = F.broadcast(table) if len(known) <= BROADCAST_DIGESTS else table
    return hashed.join(table, hashed["text_digest"] == table["_digest"], "left").select(F.col("_id").alias(id_col), "text_digest", "license", "notices")
