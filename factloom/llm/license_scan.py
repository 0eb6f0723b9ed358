"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Units of a document are its lines, its paragraphs, the whole text, and the windows of words that fit a template best,
wherever they lie (of windows that overlap the best counts; those inside a unit that matches do not). A unit of a distinct bigrams and a template of t
can reach a coefficient of at most 2 min(a, t) / (a + t); templates beyond that bound, and units that share no bigram
with any template, are passed over before bigrams are intersected. Templates of two licences whose common bigrams alone reach
the threshold (versions, kinds of one notice) are told apart by the bigrams in which they differ: a unit that agrees with no more
than half of these is not named by that template, however high its coefficient.

Edge cases: null and empty texts, and units of fewer than two words, match nothing; of equal coefficients the first
template in order wins; texts of any length are scanned whole; repeated rows repeat.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, map_batches, read_documents

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
PARAGRAPH = re.compile(r"\n[ \t]*\n+")

#: Notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "MIT-0": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "0BSD": ['Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CDDL-1.0": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'],
    "MPL-1.1": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.'],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL"],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "Artistic-2.0": ["This package is licensed under the Artistic License 2.0.", "You may use, modify and distribute this package under the terms of the Artistic License, version 2.0."],
    "MS-PL": ["This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."],
    "HPND": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"],
    "AFL-3.0": ["Licensed under the Academic Free License version 3.0"],
    "ECL-2.0": ['Licensed under the Educational Community License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.osedu.org/licenses/ECL-2.0'],
    "Beerware": ["As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under the Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "all-rights-reserved": ["All rights reserved."],
}
#: Licences of the GNU project: name, full name, version, date, years of the head.
GNU = [
    ("GPL-2.0", "General Public License", "2", "June 1991", "1989, 1991"), ("GPL-3.0", "General Public License", "3", "29 June 2007", "2007"), ("LGPL-2.0", "Library General Public License", "2", "June 1991", "1991"), ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999", "1991, 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007", "2007"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007", "2007"),
]
#: What opens the whole text of other licences.
HEADS = {
    "Apache-2.0": 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "MPL-2.0": 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    "EPL-2.0": 'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
}


def gnu_texts(title: str, version: str, date: str, years: str) -> list[str]:
    """Notices (or later, and this version only) for programs and libraries, and the head of the whole text."""
    terms = f"you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation"
    rest = f"This {{0}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details."
    later, only = f"either version {version} of the License, or (at your option) any later version.", f"version {version} of the License."
    notices = [f"This {work} is free software: {terms}; {which} {rest.format(work)}" for work in ("program", "library") for which in (later, only)]
    head = f"GNU {title} Version {version}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    return [*notices, head, f"Licensed under the GNU {title} version {version}."]


def all_templates() -> dict[str, list[str]]:
    """The stated texts, those of the GNU licences, heads, and the tag that names a licence in a source file."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, title, version, date, years in GNU:
        out.setdefault(name, []).extend(gnu_texts(title, version, date, years))
    for name, text in HEADS.items():
        out[name].append(text)
    gnu = {g[0] for g in GNU}
    for name in out:
        if name != "all-rights-reserved":
            out[name] += [f"SPDX-License-Identifier: {name}{end}" for end in (("", "-only", "-or-later") if name in gnu else ("",))]
    return out


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


def normalised(text: str) -> list[str]:
    """Lower-case words; punctuation goes, dotted numbers stay whole."""
    return WORD.findall(text.lower())


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD):
        templates = all_templates() if templates is None else templates
        made = [(len(b), i, name, b) for i, (name, t) in enumerate((n, t) for n, ts in templates.items() for t in ts) if (b := bigrams(normalised(t)))]
        self.made, self.threshold = sorted(made, key=lambda m: m[:2]), threshold
        self.sizes = [m[0] for m in self.made]
        self.any = frozenset().union(*(m[3] for m in self.made)) if made else frozenset()
        self.index: dict[tuple[str, str], list[int]] = {}
        for k, m in enumerate(self.made):
            for pair in m[3]:
                self.index.setdefault(pair, []).append(k)
        self.first = {a for a, _ in self.any}
        self.bound = threshold / (2 - threshold)  # smaller over larger size, at least
        #: By place in ``order``: (bigrams of the template alone, of the rival alone) of each rival of another licence.
        self.rivals = {m[1]: [(m[3] - r[3], r[3] - m[3]) for r in self.made if r[2] != m[2] and r[3] != m[3] and 2 * (n := len(m[3] & r[3])) >= threshold * (n + m[0])] for m in self.made}

    def candidates(self, size: int) -> list[tuple]:
        """Templates whose size leaves the coefficient a chance."""
        return self.made[bisect_left(self.sizes, size * self.bound - 1e-9) : bisect_right(self.sizes, size / self.bound + 1e-9)]

    def decided(self, i: int, own: frozenset[tuple[str, str]]) -> bool:
        """Whether a unit of bigrams agrees with template i on most of what tells it from each rival."""
        return all(2 * (len(mine & own) + len(theirs - own)) > len(mine) + len(theirs) for mine, theirs in self.rivals[i])

    def best(self, words: list[str]) -> tuple[float, int, str] | None:
        """(coefficient, -order, name) of the best template at or over the threshold."""
        if len(words) < 2 or not self.sizes or self.first.isdisjoint(words):
            return None
        own = bigrams(words)
        if len(own) * self.bound > self.sizes[-1] or self.any.isdisjoint(own):
            return None
        got = [(d, -i, name) for t, i, name, b in self.candidates(len(own)) if (d := 2 * len(own & b) / (len(own) + t)) >= self.threshold and self.decided(i, own)]
        return max(got, default=None)

    def units(self, text: str) -> list[tuple[str, list[str]]]:
        lines = [("line", normalised(x)) for x in text.split("\n")]
        out = [u for u in lines if len(u[1]) > 1]
        parts = PARAGRAPH.split(text)
        if len(parts) > 1:
            out += [("paragraph", w) for p in parts if "\n" in p.strip() and len(w := normalised(p)) > 1]
        if len(lines) > 1:
            whole = [w for _, ws in lines for w in ws]
            out.append(("text", whole))
        return out

    def windows_of(self, words: list[str], at: list[int], t: int) -> list[tuple[float, int, int]]:
        """(coefficient, first word, end) of the best window from each of the places ``at`` of a template's t bigrams."""
        found, places = [], set(at)
        for p in at:
            best = None
            own, both, j = set(), 0, p
            while j + 1 < len(words):
                pair = (words[j], words[j + 1])
                if pair not in own:
                    own.add(pair)
                    both += j in places
                if len(own) * self.bound > t or (len(own) - both + t) * self.threshold > (2 - self.threshold) * t:
                    break  # too many of other bigrams: no longer window can reach the threshold
                if j in places and (d := 2 * both / (len(own) + t)) >= self.threshold and (best is None or d > best[0]):
                    best = (d, p, j + 2)
                j += 1
            if best:
                found.append(best)
        return found

    def windows(self, text: str, matched: list[list[str]]) -> list[tuple[float, str]]:
        """(coefficient, licence) of windows apart from each other and not inside the ``matched`` units."""
        words = normalised(text)
        if self.first.isdisjoint(words):
            return []
        hits: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            for k in self.index.get(pair, ()):
                hits.setdefault(k, []).append(i)
        inside = {" " + " ".join(m) + " " for m in matched}
        found, out = [], []
        for k, at in hits.items():
            t = self.made[k][0]
            if len(at) < t * self.bound - 1e-9 or len({(words[i], words[i + 1]) for i in at}) < t * self.bound - 1e-9:
                continue
            found += [(d, t, -self.made[k][1], a, z, self.made[k][2]) for d, a, z in self.windows_of(words, at, t)]
        taken = bytearray(len(words))
        for d, _, i, a, z, name in sorted(found, reverse=True):
            if any(taken[a:z]) or not self.decided(-i, bigrams(words[a:z])):
                continue
            taken[a:z] = b"\1" * (z - a)
            own = " " + " ".join(words[a:z]) + " "
            if not any(own in m for m in inside):
                out.append((d, name))
        return out

    def scan(self, text: str) -> tuple[str | None, float, str | None, int]:
        """(licence, coefficient, unit, units that match) of a text."""
        units = self.units(text)
        found = [(got, -k, kind) for k, (kind, words) in enumerate(units) if (got := self.best(words))]
        order = {name: i for _, i, name, _ in reversed(self.made)}
        found += [((d, -order[name], name), -len(units), "window") for d, name in self.windows(text, [units[-k][1] for _, k, _ in found])]
        if not found:
            return None, 0.0, None, 0
        (dice, _, name), _, kind = max(found)
        return name, dice, kind, len(found)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, unit, n_units (that match a template) of every row; license is null where none matches."""
    scanner = LicenseScanner(templates, threshold)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [scanner.scan(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.int64())], ["doc_id", "license", "dice", "unit", "n_units"])

    return map_batches(id_and_text(docs), "doc_id bigint, license string, dice double, unit string, n_units bigint", run)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir))
