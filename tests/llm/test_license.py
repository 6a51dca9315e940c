import textwrap

from talentgrid.llm import license
from tests.llm.helpers import awkward_rows, documents

MIT = ("Copyright (c) 2021 Some One\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
       "and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice "
       "and this permission notice shall be included in all copies or substantial portions of the Software.\n"
       "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.")


def test_rules(spark):
    texts = {
        1: "Some text.\nReleased under the MIT License.\nMore.", 2: "Licensed under the Apache License, Version 2.0.",
        3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.",
        5: "All rights reserved.", 6: MIT, 7: "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
        8: "You need a fishing license here.", 9: "nothing of the kind", 10: None, 11: "", 12: "Released under the MIT License.\n" * 3,
        13: "Copyright 2020 A. All rights reserved.", 14: "x " * 50000 + ". All rights reserved."}
    got = {r.id: (r.sentence_ids, r.licenses, r.n_unknown) for r in license.scan(
        documents(spark, [(i, t, None, None) for i, t in texts.items()], clash=True)).collect()}
    assert got[1] == (["mit-ref"], ["MIT"], 0)
    assert [got[i][1] for i in (2, 3, 4, 5)] == [["Apache-2.0"], ["GPL-3.0"], ["CC-BY-NC-4.0"], ["Proprietary"]]
    assert got[6] == (["copyright", "mit-grant", "mit-notice", "as-is"], ["MIT", "Copyright"], 0)
    assert got[7][1] == ["MIT", "Apache-2.0"]
    assert got[8] == (["unknown"], [], 1)
    assert got[9] == got[10] == got[11] == ([], [], 0)
    assert got[12] == (["mit-ref"] * 3, ["MIT"], 0)
    assert got[14][1] == ["Proprietary"]


def test_order_of_sentences_matters(spark):
    """A rule is a sequence: the same sentences in another order are not the long licence."""
    rows = [(1, "You may not use this file except in compliance with the License.\nLicensed under the Apache License, Version 2.0.", None, None)]
    r = license.scan(documents(spark, rows)).first()
    assert r.sentence_ids == ["apache2-comply", "apache2-ref"] and r.licenses == ["Apache-2.0"] and r.n_unknown == 1


def test_awkward_and_empty(spark):
    rows = awkward_rows()
    out = license.scan(documents(spark, rows))
    assert out.count() == len(rows) and license.scan(documents(spark, [])).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
         "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
         "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
         "so, subject to the following conditions:")
WHOLE = {
    "MIT": ["The MIT License (MIT)", "Copyright (c) 2021 Some One", GRANT,
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
            "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
            "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["Copyright 2019 Some One", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."],
    "BSD-3-Clause": ["Copyright (c) 2001, The Holder", "All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, "
                     "are permitted provided that the following conditions are met:",
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution.",
                     "3. Neither the name of The Holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission.",
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
                     "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
                     "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
                     "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
                     "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
                     "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "ISC": ["Copyright (c) 2004 Some One", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
            "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS."],
    "GPL-3.0-or-later": ["Copyright (C) 2010 Some One", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                         "any later version.",
                         "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                         "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
                         "You should have received a copy of the GNU General Public License along with this program.  If not, see "
                         "<https://www.gnu.org/licenses/>."],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                          "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
                "public domain worldwide. This software is distributed without any warranty.",
                "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see "
                "<http://creativecommons.org/publicdomain/zero/1.0/>."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."]}


def test_whole_licences_wrapped_and_commented(spark):
    """Unshortened texts at several widths and behind comment marks: the licence and its
    copyright line, and nothing unknown."""
    rows, want = [], {}
    for name, paragraphs in WHOLE.items():
        for width in (40, 64, 72, 79, 10 ** 6):
            for mark in ("", "# ", " * ", "// ", "dnl "):
                lines = [mark + x for p in paragraphs for x in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
                want[len(rows)] = (name, any(p.startswith("Copyright") for p in paragraphs))
                rows.append((len(rows), "some code without a full stop\n\n" + "\n".join(lines) + "\nmore code", None, None))
    for r in license.scan(documents(spark, rows)).collect():
        name, holder = want[r.id]
        rest = {"BSD-3-Clause": ["Proprietary"]}.get(name, ["Copyright"] if holder else [])
        assert (r.licenses, r.n_unknown) == ([name, *rest], 0), (rows[r.id][1], r)


def test_lines_of_their_own_and_split_cues(spark):
    texts = {1: "a heading\nAll rights reserved.", 2: "a heading\nReleased under the MIT License\nand more words", 3: "these rights are all\nreserved",
             4: "it is in the public\ndomain since then", 5: "x\r\nAll rights\r\nreserved.\r\n", 6: "." * 200000 + "x licence", 7: "\n" * 200000 + "licence"}
    got = {r.id: r.sentence_ids for r in license.scan(documents(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    assert got == {1: ["all-rights"], 2: ["mit-ref"], 3: [], 4: ["unknown"], 5: ["all-rights"], 6: ["unknown"], 7: ["unknown"]}
    import re
    assert all(re.search(license.CUE, s) for s in license.SENTENCES)
    assert {i for _, ids in license.RULES for i in ids} <= set(license.SENTENCES.values())
