"""Licence scans by sentence rules.

A text is cut into sentences, at . ! ? and at blank lines; a sentence may be wrapped over
lines, with comment marks before each. Lines are also places where a sentence may begin and
end, so a notice on a line of its own is found after a line without a full stop. Text is
normalised (lower case, years and holders blanked, punctuation and white space reduced) and
the longest known licence sentences, from a line or sentence start to a line or sentence
end, are mapped to their identifiers; what is left of a sentence is ``unknown`` if it has a
licence cue. The identifiers of a document, in order, are matched against ordered licence
rules: the first rule whose identifier sequence occurs takes its sentences away, then the
next rule sees the rest, so a specific rule goes before a general one. Cue sentences that no
rule explains are reported as unknown. Everything is one scan with SQL functions; there is
no shuffle, and the sentence table is a literal of fixed size.

The table has the whole texts of MIT, BSD-2, BSD-3 and ISC, the notices that Apache-2.0, the
GNU licences, MPL-2.0 and CC0 ask to be put into files, and one-line references. The long
legal texts themselves (GPL, MPL, Creative Commons) are not in it; their cue sentences count
as unknown.

Defined results: a null or empty text has no sentences and no licence; repeated sentences
count each time, a licence is listed once; very long texts are split like any other; an
empty table gives an empty result. Only the id and text columns are looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences end at . ! ? before white space or the end, and at lines without letters or digits.
SENTENCE_END = r"(?<![.!?])[.!?]++(?=\s|$)"
BLANK_LINE = r"(?md)^[^\p{L}\p{N}\n\x01]*$"
#: A normalised sentence is looked up only if it holds one of these.
CUE = r"licen[sc]e|copyright|warrant|permission is|redistribut|all rights reserved|public domain|spdx"

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-where",
    "spdx license identifier apache 2 0": "apache2-ref",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under cc by nc 4 0": "cc-by-nc4-ref",
    "licensed under cc by 4 0": "cc-by4-ref",
    "licensed under cc by sa 4 0": "cc-by-sa4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-ref",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights",
    "copyright": "copyright",
}


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


# Whole sentences of licences and of the notices they ask for.
_WHOLE = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the Software), to deal in the Software without restriction, including without limitation "
                  "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                  "to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all "
                   "copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
              "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
                      "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
                      "OR OTHER DEALINGS IN THE SOFTWARE"],
    "mit-ref": ["The MIT License", "The MIT License (MIT)", "MIT License"],
    "isc-ref": ["ISC License", "The ISC License"],
    "isc-grant": [f"Permission to use, copy, modify, and{_or} distribute this software for any purpose with or without fee is hereby "
                  "granted, provided that the above copyright notice and this permission notice appear in all copies" for _or in ("/or", "")],
    "isc-disclaim": ["THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
                     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                   "disclaimer"],
    "bsd-endorse": [f"Neither the name of the copyright holder nor the names of {x}contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission" for x in ("its ", "")],
    "bsd-disclaim": [f"THIS SOFTWARE IS PROVIDED BY {x} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
                     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
                     for x in ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", "THE AUTHOR AND CONTRIBUTORS",
                               "THE AUTHOR", "THE COPYRIGHT HOLDER AND CONTRIBUTORS")],
    "bsd-liability": [f"IN NO EVENT SHALL THE COPYRIGHT {x} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
                      "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
                      "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                      "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
                      "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE" for x in ("HOLDER", "HOLDERS", "OWNER")],
    "bsd2-ref": ["BSD 2-Clause License", "The 2-Clause BSD License", "Licensed under the BSD 2-Clause License"],
    "bsd3-ref": ["BSD 3-Clause License", "The 3-Clause BSD License", "Licensed under the BSD 3-Clause License"],
    "apache2-where": ["You may obtain a copy of the License at", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                      "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    # "v. 2.0" ends the sentence
    "mpl2-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v",
                 "Licensed under the Mozilla Public License, version 2.0"],
    "cc0-grant": [f"To the extent possible under law, {who} dedicated all copyright and related and neighboring rights to this {what} to "
                  "the public domain worldwide" for who in ("the author(s) have", "the author has") for what in ("software", "work")],
    "cc0-warranty": ["This software is distributed without any warranty"],
    "cc0-copy": ["You should have received a copy of the CC0 Public Domain Dedication along with this software"],
    "cc0-ref": ["Licensed under CC0 1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"],
    "gnu-warranty": [f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
                     "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE" for x in ("program", "library", "software", "file")],
    "gnu-where": [f"If not, see {x}://www.gnu.org/licenses/" for x in ("http", "https")],
}
# the notices of the GNU licences: (identifier, licence, words, versions)
_GNU = (("gpl", "GPL", "GNU General Public License", ("1", "2", "3")), ("lgpl", "LGPL", "GNU Lesser General Public License", ("2.1", "3")),
        ("lgpl2", "LGPL", "GNU Library General Public License", ("2",)), ("agpl", "AGPL", "GNU Affero General Public License", ("3",)))
_GNU_RULES = []
for _key, _licence, _words, _versions in _GNU:
    _WHOLE[f"{_key}-see"] = [f"See the {_words} for more details"]
    _WHOLE[f"{_key}-copy"] = [f"You should have received a copy of the {_words} along with this {x}" for x in ("program", "library", "software", "file")]
    for _v in _versions:
        _name = f"{_licence}-{_v if '.' in _v else _v + '.0'}"
        for _id, _end, _out in ((f"{_key}{_v}-later", f"either version {_v} of the License, or (at your option) any later version", f"{_name}-or-later"),
                                (f"{_key}{_v}-grant", f"version {_v} of the License", _name)):
            _WHOLE[_id] = [f"This {x} is free software; you can redistribute it and/or modify it under the terms of the {_words} as published by "
                           f"the Free Software Foundation; {_end}" for x in ("program", "library", "software", "file")]
            _rest = ("gnu-warranty", f"{_key}-see", f"{_key}-copy", "gnu-where")
            _GNU_RULES += [(_out, (_id, *_rest[:n])) for n in (4, 3, 2, 1, 0)]
# references to Creative Commons licences by their full names
for _by, _names in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
                    ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
    _WHOLE[f"cc-{_by}4-ref"] = [f"Licensed under CC {_by} 4.0"] + [f"{x}licensed under {y}Creative Commons {_names} 4.0 International License"
                                for x in ("", "This work is ") for y in ("a ", "the ")]
for _spdx, _id in (("BSD-2-Clause", "bsd2-ref"), ("BSD-3-Clause", "bsd3-ref"), ("ISC", "isc-ref"), ("MPL-2.0", "mpl2-ref"), ("CC0-1.0", "cc0-ref"),
                   ("CC-BY-4.0", "cc-by4-ref"), ("CC-BY-SA-4.0", "cc-by-sa4-ref"), ("CC-BY-NC-4.0", "cc-by-nc4-ref"), ("GPL-2.0-only", "gpl2-ref"),
                   ("GPL-3.0-only", "gpl3-ref"), ("LGPL-3.0-only", "lgpl3-ref"), ("GPL-2.0-or-later", "gpl2-later"), ("GPL-3.0-or-later", "gpl3-later"),
                   ("LGPL-2.1-or-later", "lgpl2.1-later"), ("AGPL-3.0-only", "agpl3-grant"), ("AGPL-3.0-or-later", "agpl3-later")):
    _WHOLE.setdefault(_id, []).append(f"SPDX-License-Identifier: {_spdx}")
SENTENCES.update((_plain(x), i) for i, xs in _WHOLE.items() for x in xs)

# Ordered rules, (licence, sequence of sentence identifiers).
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-where", "apache2-url", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-where", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-where", "apache2-url")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-where")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply")),
    ("Apache-2.0", ("apache2-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaim", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaim")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaim", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaim")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("ISC", ("isc-grant", "isc-disclaim")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    *_GNU_RULES,
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("GPL", ("gpl-grant",)),
    ("CC0-1.0", ("cc0-grant", "cc0-warranty", "cc0-copy")),
    ("CC0-1.0", ("cc0-grant",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa4-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd4-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-ref",)),
    ("CC-BY-4.0", ("cc-by4-ref",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("copyright", "all-rights")),
    ("Proprietary", ("all-rights",)),
    ("Copyright", ("copyright",)),
)


#: The sentences, longest first, each from a line or sentence start to such an end.
KNOWN = r"(?<![^\n\x01])(?:" + "|".join(sorted(SENTENCES, key=lambda x: (-len(x), x))).replace(" ", r"[ \n]") + r")(?![^\n\x01])"
#: The words of CUE, which may stand on two lines.
CUE_WORD = r"(?i)licen[sc]e|copyright|warrant|permission|redistribut|reserved|domain|spdx"


def normalised(text: Column) -> Column:
    """Lower case; a copyright line is only ``copyright``; anything but a-z and digits is one
    space. Sentences are parted by ``\\x01``; a line end, colon or semicolon in them is ``\\n``."""
    x = F.concat(F.lit("\x01"), F.lower(text), F.lit("\x01"))
    for pattern, put in (
            (r"(?md)^[^\p{L}\p{N}\n\x01]*(?:dnl|rem)\b", ""),
            (SENTENCE_END, "\x01"),
            (BLANK_LINE, "\x01"),
            (r"(?md)(?:^|(?<=\x01))[^a-z0-9\n\x01]*(?:copyright|\(c\)|©)[^a-z0-9\n\x01]+(?:c|[0-9]{4})\b[^\n\x01]*", "copyright"),
            (r"[:;](?=\s)", "\n"),
            (r"[^a-z0-9\n\x01]+", " "),
            (r" ?\x01 ?", "\x01"),
            (r"[ \n]*\n[ \n]*", "\n"),
            # numbers of list items, and the holder in the third BSD condition
            (r"(?<=[\n\x01])[0-9a-d] (?=redistributions[ \n]|neither[ \n])", ""),
            (r"(?<=[\n\x01])neither[ \n]the[ \n]name[ \n]of[ \n][a-z0-9 \n]+?[ \n]nor[ \n]the[ \n]names[ \n]of(?=[ \n])",
             "neither the name of the copyright holder nor the names of")):
        x = F.regexp_replace(x, pattern, put)
    return x


def sentence_ids(text: Column) -> Column:
    """Identifiers of the cue sentences in order; ``unknown`` for one not in the table."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # known sentences between marks: every second part is one
    parts = F.split(F.regexp_replace(normalised(text.cast("string")), KNOWN, "\x02$0\x02"), "\x02")
    cues = lambda x: F.filter(F.split(x, "\x01"), lambda s: F.translate(s, "\n", " ").rlike(CUE))
    ids = F.flatten(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.array(
        F.try_element_at(known, F.translate(x, "\n", " ")))).otherwise(F.transform(cues(x), lambda s: F.lit("unknown")))))
    return F.when(text.cast("string").rlike(CUE_WORD), ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: its id, ``sentence_ids`` (array), ``licenses`` (array, by rule
    order) and ``n_unknown``, the cue sentences that no rule explains."""
    d = docs.select(F.col(id_col).alias("id"), sentence_ids(F.col(text_col)).alias("sentence_ids"))
    # the identifiers as one string, each between bars; a rule takes its sentences away
    d = d.withColumn("rest0", F.concat(F.lit("|"), F.array_join(
        F.transform("sentence_ids", lambda s: F.concat(s, F.lit("|"))), "|")))
    found = []
    for i, (name, ids) in enumerate(RULES):
        rule = "|" + "||".join(ids) + "|"
        found.append(F.when(F.contains(F.col(f"rest{i}"), F.lit(rule)), F.lit(name)))
        d = d.withColumn(f"rest{i + 1}", F.replace(F.col(f"rest{i}"), F.lit(rule), F.lit("|~|")))
    left = F.filter(F.split(f"rest{len(RULES)}", r"\|"), lambda s: (s != "") & (s != "~"))
    return d.select("id", "sentence_ids", F.array_distinct(F.array_compact(F.array(*found))).alias("licenses"),
                    F.size(left).cast("long").alias("n_unknown"))
