"""Licence scans: a trained paragraph classifier confirmed by templates.

Texts are cut into paragraphs at blank lines. A paragraph, and each run of its lines, is a
bag of hashed word unigrams and bigrams; a sparse softmax regression gives the licence
family, 'other' for what reads like a notice of no known family, or 'unknown' for what is
none. It is trained on variants of the templates (cut, with words dropped) and of
notices of invented licences against lines of a bounded corpus sample and near misses;
its temperature is fitted on lines, near misses and more damaged variants that it was not
trained on. A prediction counts as confirmed if a template of its family shares enough
word bigrams with the lines, none of another family shares more, and the names, clauses
and versions that the lines state are those of the family: neighbours such as GPL and
AGPL, CC BY and CC BY-ND, or two versions of a licence differ by little else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import least_hashes
from loamline.llm.minhash_dedup import _mix, word_hashes

BITS = 14
UNKNOWN, OTHER = "unknown", "other"

#: Short notices by which texts name their licence.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license."],
    "mit": ["Released under the MIT License.", "This software is licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "bsd": ["Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Licensed under the GPL v2 or later."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright (CC0).", "Released into the public domain under CC0 1.0."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": ["Released under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "artistic": ["Released under the Artistic License 2.0.", "This program may be distributed under the terms of the Artistic License."],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission of the publisher."],
}
#: Identifiers of families in SPDX tags.
SPDX: dict[str, str] = {
    "apache-2.0": "Apache-2.0", "mit": "MIT", "bsd": "BSD-3-Clause", "gpl": "GPL-3.0-or-later", "lgpl": "LGPL-2.1-or-later", "agpl": "AGPL-3.0-or-later", "mpl-2.0": "MPL-2.0",
    "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-nd": "CC-BY-ND-4.0", "cc-by-nc-sa": "CC-BY-NC-SA-4.0", "cc-by-nc-nd": "CC-BY-NC-ND-4.0", "cc0": "CC0-1.0",
    "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", "artistic": "Artistic-2.0", "epl": "EPL-2.0", "boost": "BSL-1.0",
}
#: How notices state the names and clauses that tell families apart.
STATED: dict[str, str] = {
    "apache": r"(?i:\bapache\b)",
    "mit": r"\bMIT\b|(?i:\bmit[ /-](?:licen[sc]e|x11))",
    "bsd": r"(?i:\bbsd\b)",
    "gpl": r"(?i:\bgpl|(?<!affero )(?<!lesser )(?<!library )\bgeneral public licen[sc]e)",
    "lgpl": r"(?i:\blgpl|\b(?:lesser|library) general public)",
    "agpl": r"(?i:\bagpl|\baffero\b)",
    "mpl": r"(?i:\bmpl\b|\bmozilla public)",
    "by": r"(?i:\bcreative commons attribution|\bcc[ -]by\b)",
    "sa": r"(?i:\bshare[ -]?alike|\bby(?:[ -]nc)?[ -]sa\b)",
    "nc": r"(?i:\battribution[ -]non-?commercial|\bby[ -]nc\b)",
    "nd": r"(?i:\bno[ -]?deriv|\bby(?:[ -]nc)?[ -]nd\b)",
    "cc0": r"(?i:\bcc0\b)",
    "isc": r"\bISC\b|(?i:\bisc licen[sc]e)",
    "zlib": r"(?i:\bzlib)",
    "unlicense": r"(?i:\bunlicense)",
    "artistic": r"(?i:\bartistic[ -](?:licen[sc]e|[12]))",
    "epl": r"(?i:\bepl\b|\beclipse public)",
    "boost": r"(?i:\bboost software|\bbsl-1)",
}
#: What a notice of a family has to state, and what else it may; families that are not listed may state their own name only.
REQUIRED: dict[str, set[str]] = {
    "lgpl": {"lgpl"}, "agpl": {"agpl"}, "artistic": {"artistic"}, "epl": {"epl"}, "boost": {"boost"}, "cc-by": {"by"}, "cc-by-sa": {"by", "sa"}, "cc-by-nc": {"by", "nc"},
    "cc-by-nd": {"by", "nd"}, "cc-by-nc-sa": {"by", "nc", "sa"}, "cc-by-nc-nd": {"by", "nc", "nd"},
}
ALLOWED: dict[str, set[str]] = {"apache-2.0": {"apache"}, "mpl-2.0": {"mpl"}, "lgpl": {"gpl"}, "agpl": {"gpl"}}
#: Families of one version, and how notices state it.
VERSIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": (r"(?i)\bapache\b(?:[ ,(-]+(?:software|public|licen[sc]e|version|v))*[ ,-]*v?\.? ?([0-9]+(?:\.[0-9]+)?)", ("2", "2.0")),
    "mpl-2.0": (r"(?i)\b(?:mozilla public|mpl)\b(?:[ ,(-]+(?:licen[sc]e|version|v))*[ ,-]*v?\.? ?([0-9]+(?:\.[0-9]+)?)", ("2", "2.0")),
}
#: The paragraphs of full notices of the common families.
NOTICES: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: What notices of other licences say; {} stands for an invented name.
GENERIC = ["Licensed under the {} License.", "Licensed under the {} Licence, version 1.1.", "This work is released under the terms of the {} Public License.", "Distributed under the {} Software License, see the accompanying file for details.", "You may use, copy and distribute this work under the terms of the {} License Agreement.", "The software is covered by the {} Community License; the full text of the license is in the file LICENSE.", "Use of this material is subject to the {} Open Licence.", "By using this product you accept the {} end user license agreement."]
#: Sentences that share words with notices and are none.
NEAR_MISSES = ["The driver lost his license after the accident.", "A fishing license is required in this county.", "The version of the work was released under pressure.", "Public use of the general terms is not a condition.", "The new version 2.0 was released this week.", "This work is based on the general idea of a public library.", "Permission to enter was granted to any person.", "He studied at MIT and worked under a professor.", "The Apache helicopter was licensed for export.", "No part of this town may be entered without a guide.", "The source of the river is subject to debate.", "She renewed her driving licence last week.", "The pub lost its liquor license in the spring.", "The software was distributed on discs to every school.", "The agreement between the two towns covers the use of the river.", "The library lends work by local authors to the public.", "You may copy this file to the other disk and use it there.", "A copyright lawyer gave a talk at the museum.", "His general permission to use the hall was withdrawn.", "The community accepted the terms of the mayor's open letter.", "Free entry is granted to any person under sixteen.", "The notice on the door said that the office was closed.", "The file contains a copy of the public record."]
#: Further ones, for the temperature alone.
HELD_MISSES = ["The officer checked my licence and let me go.", "All rights of way are reserved for walkers.", "The source of the work was never released.", "Version 3 of the plan was published under the title of the old one.", "They were granted permission to sell copies of the map.", "The public was asked to comply with the new conditions."]


#: Bytes that are read at a time, but for single words that are longer.
PART = 1 << 20


def _word_parts(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket of each word, of each bigram starting there (its own word at a line's end), and the word's line, in parts of ``PART`` bytes; lines end with line feeds."""
    at, line_no, shift = 0, 0, np.uint64(64 - BITS)
    words, line = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    while at < len(data):
        cut = _CUT.search(data, at + PART) if len(data) - at > PART else None
        stop = cut.end() if cut else len(data)
        part = _DOTS.sub(b" ", _MARKS.sub(b" ", data[at:stop]))
        raw = np.frombuffer(part, dtype=np.uint8)
        space = (raw == 32) | (raw == 10)
        starts, ends = np.flatnonzero(~space & np.r_[True, space[:-1]]), np.flatnonzero(raw == 10)
        # the last word of the part before waits for the one that follows it
        words, line = np.r_[words, word_hashes(part)], np.r_[line, np.searchsorted(ends, starts) + line_no]
        # a word that only repeats the one before says nothing more
        new = np.r_[True, (words[1:] != words[:-1]) | (line[1:] != line[:-1])] if len(words) else np.empty(0, dtype=bool)
        words, line, at, line_no = words[new], line[new], stop, line_no + len(ends)
        following = np.where(np.r_[line[1:] == line[:-1], False], np.r_[words[1:], words[:1]], np.uint64(0)) if len(words) else words
        pairs = _mix(words * np.uint64(3) + following)
        n = len(words) if at == len(data) else max(0, len(words) - 1)
        yield (words[:n] >> shift).astype(np.int64), (pairs[:n] >> shift).astype(np.int64), line[:n]
        words, line = words[n:], line[n:]


_MARKS, _DOTS = re.compile(rb"[^0-9A-Za-z\x80-\xff\n.]+"), re.compile(rb"\.+(?=[ \n]|$)")
_CUT = re.compile(rb"[^0-9A-Za-z\x80-\xff.]")


def _encoded(line: str) -> bytes:
    return line.encode("utf-8", "surrogatepass").replace(b"\n", b" ") + b"\n"


def _bag(line: str) -> np.ndarray:
    parts = list(_word_parts(_encoded(line)))
    words, pairs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return np.r_[words, pairs[:-1] + (1 << BITS)]


@dataclass
class LicenceModel:
    families: list[str]
    weights: np.ndarray  # (2 * 2^BITS + 1, families), the last row is the bias
    temperature: float

    def sums(self, data: bytes, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights (lines x families) and words of each line, in parts of bounded memory."""
        total, n, before = np.zeros((lines, len(self.families))), np.zeros(lines, dtype=np.int64), None
        for words, pairs, line in _word_parts(data):
            # a bigram counts unless its word is the last of its line, which the next part may tell
            if before is not None and len(line) and line[0] == before[1]:
                total[before[1]] += self.weights[before[0] + (1 << BITS)]
            last = np.r_[line[1:] != line[:-1], True] if len(line) else np.empty(0, dtype=bool)
            for at in range(0, len(words), 1 << 16):
                part = slice(at, at + (1 << 16))
                w = self.weights[words[part]] + self.weights[pairs[part] + (1 << BITS)] * ~last[part, None]
                first = np.flatnonzero(np.r_[True, np.diff(line[part]) > 0])
                np.add.at(total, line[part][first], np.add.reduceat(w, first, axis=0))
            if len(line):
                n[line[0] : line[-1] + 1] += np.bincount(line - line[0])
                before = pairs[-1], line[-1]
        return total, n

    def softmax(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of bags with the summed weights and n words."""
        logits = (total / np.sqrt(np.maximum(n, 1))[:, None] + self.weights[-1]) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def probabilities(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """The text's lines and, for each, the probability of every family."""
        lines = (text or "").split("\n")
        return lines, self.softmax(*self.sums(b"".join(map(_encoded, lines)), len(lines)))


def _variants(rng: np.random.Generator, line: str, n: int, drop: float = 0.08) -> list[str]:
    """Cut and damaged copies of a template."""
    words, out = line.split(), []
    for _ in range(n):
        keep = [w for w in words if rng.random() > drop] or words
        if len(keep) > 8 and rng.random() < 0.4:
            at = int(rng.integers(0, len(keep) - 7))
            keep = keep[at : at + int(rng.integers(7, len(keep) + 1))]
        if rng.random() < 0.3:
            keep = ["Copyright", "(c)", str(int(rng.integers(1990, 2030))), *keep]
        out.append(" ".join(keep).upper() if rng.random() < 0.1 else " ".join(keep))
    return out


def _invented(rng: np.random.Generator, n: int) -> list[str]:
    """Notices of licences that do not exist."""
    name = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9)))).capitalize()
    return [GENERIC[k % len(GENERIC)].format(" ".join(name() for _ in range(int(rng.integers(1, 3))))) for k in range(n)]


_TAG = "SPDX-License-Identifier: {}"
_KNOWN = re.compile(r"licen[sc]e|copyright|all rights reserved|\bCC\b", re.I)


def _no_notice(line: str) -> bool:
    """Whether a corpus line can stand for what is no notice: without a word of licences, or with little in common with any template."""
    return not _KNOWN.search(line) or max(template_match(f, line) for f in TEMPLATES) < 0.3


def fit(lines: list[str], *, variants: int = 60, epochs: int = 12, seed: int = 7) -> LicenceModel:
    """Train on variants of notices against ``lines`` of the corpus; every fifth of the lines, and other near misses, are kept for the temperature."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, OTHER, *TEMPLATES]
    plain = [x for x in lines if _no_notice(x)]
    used = [(x, 0) for k, x in enumerate(plain) if k % 5] + [(v, 0) for m in NEAR_MISSES for v in [m, *_variants(rng, m, 20)]]
    held = [(x, 0) for x in plain[::5]] + [(v, 0) for m in HELD_MISSES for v in [m, *_variants(rng, m, 20)]]
    used += [(v, 1) for x in _invented(rng, 4 * variants) for v in _variants(rng, x, 1)]
    held += [(x, 1) for x in _invented(rng, variants)]
    for k, f in enumerate(families[2:], 2):
        for t in TEMPLATES[f]:
            used += [(v, k) for v in [t, *_variants(rng, t, variants)]]
            held += [(v, k) for v in _variants(rng, t, variants // 4, 0.2)]
        if f in SPDX:
            # tags are short: cut ones would be no more than a word
            used += [(x, k) for x in 8 * [_TAG.format(SPDX[f])]]
        for t in NOTICES.get(f, ()):
            used += [(v, k) for v in [t, *_variants(rng, t, variants // 3)]]
            held += [(v, k) for v in _variants(rng, t, variants // 12, 0.2)]
    bags, y = [_bag(x) for x, _ in used], [k for _, k in used]
    weights, step = np.zeros(((2 << BITS) + 1, len(families))), 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            scale = 1 / np.sqrt(max(1, (len(bags[i]) + 1) // 2))
            z = weights[bags[i]].sum(axis=0) * scale + weights[-1]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            np.subtract.at(weights, bags[i], step * scale * p)
            weights[-1] -= 0.05 * step * p
        step *= 0.8
    model = LicenceModel(families, weights.astype(np.float32), 1.0)
    total, n = model.sums(b"".join(_encoded(x) for x, _ in held), len(held))
    truth, losses = np.array([k for _, k in held]), []
    for t in np.geomspace(0.25, 8, 21):
        model.temperature = float(t)
        p = model.softmax(total, n)
        losses.append((-np.log(np.maximum(p[np.arange(len(held)), truth], 1e-12)).mean(), float(t)))
    model.temperature = min(losses)[1]
    return model


def _bigrams(line: str) -> set[tuple[str, str]]:
    words = re.findall(r"[^\W_]+(?:\.[0-9]+)*", line.lower())
    return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}


_TEMPLATE_BIGRAMS = {f: [_bigrams(t) for t in [*ts, *NOTICES.get(f, ()), *([_TAG.format(SPDX[f])] if f in SPDX else [])]] for f, ts in TEMPLATES.items()}


def template_match(family: str, line: str) -> float:
    """The largest share of the shorter side's word bigrams that the line and a template of the family have in common."""
    own = _bigrams(line)
    return max((len(own & t) / max(1, min(len(own), len(t))) for t in _TEMPLATE_BIGRAMS.get(family, ())), default=0.0)


_STATED = {name: re.compile(p) for name, p in STATED.items()}
_VERSIONS = {f: (re.compile(p), own) for f, (p, own) in VERSIONS.items()}


def stated(line: str) -> set[str]:
    """The names and clauses of licences that the lines state."""
    return {name for name, p in _STATED.items() if p.search(line)}


def _own(family: str) -> set[str]:
    return REQUIRED.get(family) or ALLOWED.get(family, {family})


def _other_version(family: str, line: str) -> bool:
    pattern, versions = _VERSIONS.get(family, (None, ()))
    return bool(pattern) and any(v not in versions for v in pattern.findall(line))


def fits(family: str, line: str, said: set[str]) -> bool:
    """Whether what the lines state is what notices of the family state: no name or clause of others, none of its own missing, no other version."""
    required = REQUIRED.get(family, set())
    return required <= said <= required | ALLOWED.get(family, {family}) and not _other_version(family, line)


def _compared(family: str, line: str, match: float) -> tuple[str, float, bool]:
    """(family, template match, confirmed) of a predicted notice.

    If it states other names than those of the predicted family, the one family that they
    fit takes its place. Notices of several licences keep the predicted one, not confirmed,
    if they name it; all else is 'other'.
    """
    said = stated(line)
    if family == OTHER or not fits(family, line, said):
        named = [f for f in TEMPLATES if _own(f) <= said and fits(f, line, said)]
        if not named:
            nearer = any(_own(family) < REQUIRED[f] <= said for f in REQUIRED)
            several = family != OTHER and _own(family) <= said and not nearer and not _other_version(family, line)
            return (family, template_match(family, line), False) if several else (OTHER, 0.0, False)
        family = named[0]
    share = template_match(family, line)
    return family, share, share >= match and all(template_match(f, line) <= share for f in TEMPLATES if f != family and fits(f, line, said))


def sample_lines(docs: DataFrame, n: int) -> list[str]:
    """At most ``n`` lines of the corpus, whole, from all lines of all texts: those with the least hashes of document, place and content.

    Only these come to the driver, with at most ``SAMPLE_BYTES`` bytes in all.
    """
    rows = docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter("trim(line) <> ''")
    few = least_hashes(rows, n, "doc_id", "at", "line").select(F.xxhash64("doc_id", "at", "line").alias("h"), "line")
    upto = Window.orderBy("h", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("bytes", F.sum(F.octet_length("line")).over(upto)).filter(F.col("bytes") <= SAMPLE_BYTES)
    return sorted(r.line for r in few.select("line").collect())


SAMPLE_BYTES = 8 << 20


def _notices(model: LicenceModel, lines: list[str], total: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple[int, int, str, float]]:
    """(first line, lines, family, probability) of the notices of one text.

    In a paragraph that reads like a notice as a whole, the run of lines that speaks most
    for its family is one; elsewhere each run of lines that read like the same family is.
    """
    def judged(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest family, or 'other' if none reaches the threshold, and how likely a notice it is: 0 if less than the threshold."""
        best = p[:, 1:].argmax(axis=1) + 1
        best = np.where(p[np.arange(len(p)), best] >= threshold, best, 1)
        notice = 1 - p[:, 0]
        return best, np.where(notice >= threshold, notice, 0)

    best, sure = judged(model.softmax(total, n))
    flagged = (sure > 0) & (n > 0)
    blank = np.array([not x.strip() for x in lines], dtype=bool)
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    stops = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    many = np.flatnonzero(stops - starts > 1)
    whole = {}
    if len(many):
        sums = np.add.reduceat(np.vstack([total, np.zeros((1, total.shape[1]))]), np.c_[starts[many], stops[many]].ravel(), axis=0)[::2]
        counts = np.add.reduceat(np.r_[n, 0], np.c_[starts[many], stops[many]].ravel())[::2]
        whole = {int(b): int(k) for b, k, x in zip(many, *judged(model.softmax(sums, counts)), strict=True) if x > 0}
    marks = np.flatnonzero(flagged)
    blocks = set(whole) | {int(b) for b in np.searchsorted(starts, marks, side="right") - 1}
    for b in sorted(blocks):
        first, stop = int(starts[b]), int(stops[b])
        runs = []
        if b in whole:
            k = whole[b]
            i, j = _best_run(total[first:stop, k] - total[first:stop, 0])
            runs.append((first + i, first + j, k))
        i = first
        while i < stop:
            j = i + 1
            if flagged[i] and not (runs and b in whole and runs[0][0] <= i < runs[0][1]):
                while j < stop and flagged[j] and best[j] == best[i]:
                    j += 1
                runs.append((i, j, int(best[i])))
            i = j
        for i, j, k in sorted(runs):
            q = model.softmax(total[i:j].sum(axis=0, keepdims=True), n[i:j].sum(keepdims=True))[0]
            yield i, j - i, model.families[k], float(q[k] if k > 1 else 1 - q[0])


def _best_run(margins: np.ndarray) -> tuple[int, int]:
    """The consecutive places of the largest sum."""
    sums = np.r_[0.0, np.cumsum(margins)]
    low = np.minimum.accumulate(sums)[:-1]
    stop = int((sums[1:] - low).argmax()) + 1
    return int(sums[:stop].argmin()), stop


def _scan(model: LicenceModel, threshold: float, match: float):
    def found(ids: list, texts: list[str]) -> Iterator[tuple]:
        """Notices of several texts, whose lines are weighed together."""
        lines = [t.split("\n") for t in texts]
        total, n = model.sums(b"".join(t.encode("utf-8", "surrogatepass") + b"\n" for t in texts), sum(map(len, lines)))
        at = 0
        for doc_id, own in zip(ids, lines, strict=True):
            for first, count, family, probability in _notices(model, own, total[at : at + len(own)], n[at : at + len(own)], threshold):
                family, share, confirmed = _compared(family, " ".join(own[first : first + count]), match)
                yield doc_id, first, count, family, probability, share, confirmed
            at += len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids, texts, size = [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if text.as_py():
                    ids.append(doc_id)
                    texts.append(text.as_py())
                    size += len(texts[-1])
                if size > 1 << 18:
                    out += found(ids, texts)
                    ids, texts, size = [], [], 0
            out += found(ids, texts) if texts else []
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "paragraph", "n_lines", "family", "probability", "template_match", "confirmed"])

    return run


def scan(docs: DataFrame, model: LicenceModel, *, threshold: float = 0.5, match: float = 0.6) -> DataFrame:
    """The licence notices of all documents, a row for each paragraph, or run of its lines, whose family is not 'unknown'.

    Returns doc_id, paragraph (0-based line that it starts at), n_lines, family ('other' if
    it reads like a notice of none that is known, if no family reaches the threshold, or
    if it names other licences; the family that it names if the model takes it for a neighbour), probability (calibrated; of families equally likely the
    first of the model's; for 'other', that it is a notice at all), template_match and
    confirmed (match of ``match`` or more, as in the module's docstring).
    Whole texts are scanned, in parts of 1 MB or a word. ``docs`` needs doc_id and text; other columns are
    ignored. Null and empty texts have no notices; repeated rows give theirs each; an
    empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(model, threshold, match), f"doc_id {kind}, paragraph int, n_lines int, family string, probability double, template_match double, confirmed boolean")
