"""License scans: TF-IDF cosine to templates, then the nearest ancestor directory.

1. Document frequencies of the templates' terms over all texts (one row a term,
   so the result is bounded by the templates).
2. A text's units are compared with each template: each line, each sentence of a
   line with several, each paragraph (lines between blank ones), each run of
   neighbouring lines that could match by themselves, and the whole text. The
   text's license is its best unit's best template, from `threshold` on.
3. A file without one inherits: the distinct directories give their ancestors,
   these meet the directories that hold a license file, and the deepest wins.

A unit is compared only if it could reach the threshold at all: a template's
vector lies in the known terms, so by Cauchy-Schwarz the cosine is at most the
known terms' share |known| / |unit| of the unit's norm. That loses no match.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own, text_batches, written

THRESHOLD = 0.6
TERMS = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
SENTENCES = re.compile(r"(?<=[.!?;])\s+")
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-].*)?$"
#: Templates are sent to every task, so their size is bounded.
MAX_TEMPLATE_BYTES = 16 << 20

#: Identifiers and titles of public licenses. NOTICES makes a template of each with its title or identifier.
TITLES = {
    "0BSD": "BSD Zero Clause License",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "Artistic-2.0": "Artistic License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "Creative Commons CC0 1.0 Universal",
    "EPL-2.0": "Eclipse Public License, Version 2.0",
    "EUPL-1.2": "European Union Public Licence, Version 1.2",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "Unlicense": "Unlicense",
    "Zlib": "zlib License",
}
NOTICES = ("Licensed under the {title}.", "Released under the {title}.", "This work is licensed under the {title}.", "SPDX-License-Identifier: {id}")
#: Short forms of the deeds, as pages state them.
DEEDS = ("Licensed under {deed}.", "Released under {deed}.")

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
    "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GPL = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, {version}. "
    "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the {title} for more details. You should have received a copy of the {title} along with this {thing}. If not, see https://www.gnu.org/licenses/."
)
#: The wording that licenses ask to be put into files, and the whole texts of the short ones.
WORDING = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END],
    "AGPL-3.0": [_GPL.format(thing="program", title="GNU Affero General Public License", version="either version 3 of the License, or (at your option) any later version")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
        "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "BSD-2-Clause": [_BSD + _BSD_END],
    "BSD-3-Clause": [_BSD + _BSD_THIRD + _BSD_END, _BSD_THIRD],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0": [_GPL.format(thing="program", title="GNU General Public License", version="either version 2 of the License, or (at your option) any later version")],
    "GPL-3.0": [_GPL.format(thing="program", title="GNU General Public License", version="either version 3 of the License, or (at your option) any later version")],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END],
    "LGPL-2.1": [_GPL.format(thing="library", title="GNU Lesser General Public License", version="either version 2.1 of the License, or (at your option) any later version")],
    "LGPL-3.0": [_GPL.format(thing="library", title="GNU Lesser General Public License", version="either version 3 of the License, or (at your option) any later version")],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. " + _AS_IS
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ],
}


def standard_templates() -> dict[str, list[str]]:
    """license -> templates: its notices, the deeds' short forms, its wording."""
    out = {}
    for name, title in TITLES.items():
        deed = name.replace("-", " ").replace("BY NC", "BY-NC").replace("NC SA", "NC-SA").replace("NC ND", "NC-ND").replace("BY SA", "BY-SA").replace("BY ND", "BY-ND")
        short = [d.format(deed=deed) for d in DEEDS] if name.startswith("CC") else []
        out[name] = [n.format(id=name, title=title) for n in NOTICES] + short + WORDING.get(name, [])
    return out


def read_templates(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Whole license texts of a folder, named by their files' names without a suffix."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), "value")
    if (files.agg(F.sum(F.octet_length("value"))).first()[0] or 0) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates take over {MAX_TEMPLATE_BYTES} bytes")
    out: dict[str, list[str]] = {}
    for r in files.orderBy("name").collect():
        out.setdefault(r.name, []).append(r.value)
    return out


def terms(text: str) -> list[str]:
    return TERMS.findall(text.lower())


class Scanner:
    """Matches texts to templates under given document frequencies."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, threshold: float):
        import numpy as np

        self.threshold = threshold
        self.unseen = math.log(n + 1) + 1
        flat = [(name, Counter(terms(t))) for name, texts in sorted(templates.items()) for t in texts]
        self.names = [name for name, _ in flat]
        self.at = {w: i for i, w in enumerate(sorted({w for _, c in flat for w in c}))}
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in self.at}
        #: Postings: of term i the templates that have it, starts[i] to starts[i + 1], with weights that make each template's length 1.
        entries = []
        for j, (_, count) in enumerate(flat):
            weights = {w: k * self.idf[w] for w, k in count.items()}
            length = max(math.sqrt(sum(x * x for x in weights.values())), 1e-300)
            entries += [(self.at[w], j, x / length) for w, x in weights.items()]
        entries.sort()
        self.starts = np.searchsorted(np.array([e[0] for e in entries], np.int64), np.arange(len(self.at) + 1))
        self.of = np.array([e[1] for e in entries], np.int64)
        self.weights = np.array([e[2] for e in entries])
        self.least = threshold**2 / max(1 - threshold**2, 1e-300)

    def possible(self, unit: list[str]) -> bool:
        """Whether known terms could make up the threshold's share of the unit's norm; cheap, and never wrongly false."""
        known = [self.idf[w] for w in unit if w in self.idf]
        # |known| is at most the sum of its weights, and |unknown|^2 at least one unseen weight's square a term.
        return bool(known) and sum(known) ** 2 * (1 + 1e-9) >= self.least * (len(unit) - len(known)) * self.unseen**2

    def best(self, unit: list[str]) -> tuple[float, int]:
        """(cosine, template) of the best template; (0.0, 0) if none can reach the threshold."""
        import numpy as np

        known, unknown = [], 0.0
        rows = []
        for w, k in Counter(unit).items():
            if (i := self.at.get(w)) is None:
                unknown += k * k
            else:
                rows.append(i)
                known.append(k * self.idf[w])
        inside = sum(x * x for x in known)
        outside = unknown * self.unseen**2
        if not inside or inside * (1 + 1e-9) < self.least * outside:
            return 0.0, 0
        parts = [(self.of[self.starts[i] : self.starts[i + 1]], x * self.weights[self.starts[i] : self.starts[i + 1]]) for i, x in zip(rows, known)]
        scores = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(self.names))
        scores = np.round(scores / math.sqrt(inside + outside), 9)
        j = int(scores.argmax())
        return float(scores[j]), j

    def units(self, text: str):
        """(first line from 0, terms) of every unit that may match."""
        lines = text.split("\n")
        found = [terms(line) for line in lines]
        run: list[str] = []
        paragraph: list[str] = []
        run_at = par_at = run_lines = par_lines = 0
        for i, unit in enumerate([*found, []]):
            ok = bool(unit) and self.possible(unit)
            if ok:
                yield i, unit
                if not run_lines:
                    run, run_at = [], i
                run.extend(unit)
                run_lines += 1
            elif run_lines:
                if run_lines > 1:
                    yield run_at, run
                run_lines = 0
            if i < len(lines) and lines[i].strip():
                if not par_lines:
                    paragraph, par_at = [], i
                paragraph.extend(unit)
                par_lines += 1
            elif par_lines:
                if par_lines > 1 and self.possible(paragraph):
                    yield par_at, paragraph
                par_lines = 0
            if i < len(lines) and unit:
                sentences = SENTENCES.split(lines[i])
                if len(sentences) > 1:
                    for s in sentences:
                        if self.possible(t := terms(s)):
                            yield i, t
        whole = [w for unit in found for w in unit]
        if len(lines) > 1 and self.possible(whole):
            yield 0, whole

    def scan(self, text: str | None) -> tuple[str | None, float, int]:
        """(license, cosine, its unit's first line from 0); (None, 0.0, -1) without a match.

        The highest cosine wins, then the earlier line, then the license by name.
        """
        top = max(((score, -at, -j) for at, unit in (self.units(text) if text else ()) for score, j in [self.best(unit)]), default=(0.0, 0, 0))
        return (self.names[-top[2]], top[0], -top[1]) if top[0] >= self.threshold else (None, 0.0, -1)


def frequencies(files: DataFrame, templates: dict[str, list[str]], text_col: str = "text") -> tuple[dict[str, int], int]:
    """(documents that hold each template term, all documents), over whole texts."""
    vocabulary = {w for texts in templates.values() for t in texts for w in terms(t)}

    def run(batches):
        import pyarrow as pa

        count: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                count[""] += 1
                count.update(vocabulary.intersection(terms(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    text_batches(files.sparkSession)
    rows = files.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r.term: r.n for r in rows}  # at most one row a template term
    return df, df.pop("", 0)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id_col, path_col, own_license, score, line, license, license_dir) for each file.

    own_license is what the file's own text says; license is that, else the one
    of the nearest directory above (its own included) that holds a license file
    (LICENSE, COPYING, NOTICE ...) with a match; license_dir names it. Of several
    license files in a directory the best score wins, then the smaller path.

    Null and empty texts match nothing but inherit. A null path has no
    directories. A path without a slash lies in the top directory, the empty
    string. Very long texts are read whole. Repeated rows give repeated results,
    an empty table none. Other columns are ignored, whatever their names.
    """
    chosen = templates or standard_templates()
    if sum(len(t.encode()) for texts in chosen.values() for t in texts) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates take over {MAX_TEMPLATE_BYTES} bytes")
    kind = files.schema[id_col].dataType.simpleString()
    files = own(files, *[c for c in files.columns if c not in (id_col, path_col, text_col)]).select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    df, n = frequencies(files, chosen)

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(chosen, df, n, threshold)
        for b in batches:
            found = [scanner.scan(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int32())],
                ["id", "path", "own_license", "score", "line"],
            )

    marked = files.mapInArrow(run, f"id {kind}, path string, own_license string, score double, line int")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.when(F.col("path").contains("/"), F.expr("left(path, length(path) - length(element_at(split(path, '/'), -1)) - 1)")).when(F.col("path").isNotNull(), F.lit(""))
    # Read three times below; without the texts it is small.
    marked = written(marked.withColumn("dir", folder), "licenses")
    held = (
        marked.where(name.rlike(LICENSE_NAMES) & F.col("own_license").isNotNull())
        .groupBy("dir", "path")
        .agg(F.max_by("own_license", "score").alias("own_license"), F.max("score").alias("score"))
        .groupBy("dir")
        .agg(F.min_by("own_license", F.struct(-F.col("score"), F.col("path"))).alias("dir_license"))
        .withColumnRenamed("dir", "at")
    )
    dirs = marked.where("own_license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    met = dirs.select("dir", F.posexplode(above).alias("depth", "up")).join(held, F.col("up") == F.col("at"))
    nearest = met.groupBy("dir").agg(F.max_by(F.struct("dir_license", "at"), "depth").alias("got")).select(F.col("dir").alias("of"), "got")
    out = marked.join(nearest, (F.col("dir") == F.col("of")) & F.col("own_license").isNull(), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        "own_license",
        "score",
        "line",
        F.coalesce("own_license", "got.dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("got.at")).alias("license_dir"),
    )
