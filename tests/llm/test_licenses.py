from rowceil.llm import common, licenses


def test_whole_table_and_odd_texts(spark, make_docs, odd_texts):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "plain words"), ("a/b/c/y.txt", None), ("a/b/own.txt", "text " * 40 + ". This work is licensed under the GNU General Public License, version 3. more"),
             ("d/z.txt", "nothing here"), ("d/notice.txt", "All rights reserved."), ("d/long.txt", "many words " * 30 + "\nLicensed under CC BY-NC 4.0.\n"), ("top.txt", "the licence of this is not said"), (None, "x"), ("a/b/x.txt", "plain words")]
    rows = [(i, p, t, "x", 1) for i, (p, t) in enumerate(files)] + [(100 + i, f"o/{i}", t, "x", 2) for i, t in enumerate(odd_texts)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, license string, dir int")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(rows)
    assert (got[0].own_license, got[0].license, got[0].inherited_from) == ("MIT", "MIT", None)
    assert (got[1].license, got[1].inherited_from, got[1].levels) == ("MIT", "a", 1) == (got[9].license, got[9].inherited_from, got[9].levels)
    assert (got[2].license, got[2].levels) == ("MIT", 2)
    assert (got[3].own_license, got[3].license, got[3].levels) == ("GPL-3.0", "GPL-3.0", None)
    assert (got[4].license, got[4].inherited_from, got[4].levels) == ("Proprietary", "d", 0)
    assert got[6].own_license == "CC-BY-NC-4.0" and got[6].cosine >= licenses.LEAST_COSINE
    assert got[7].license is None and got[8].license is None and got[8].path == ""
    assert all(got[100 + i].license is None for i in range(len(odd_texts)))
    assert licenses.scan(df.where("doc_id < 0")).count() == 0


def test_every_template_finds_itself(spark):
    assert all(any(m in t.lower() for m in licenses.MARKS) for _, t in licenses.TEMPLATES)
    texts = [(license, f"some words before\n{t}\nand after " + "word " * 20 if len(t) < 120 else f"some words before\n\n{t}\n\nand after " + "word " * 20) for license, t in licenses.TEMPLATES]
    df = spark.createDataFrame([(i, f"x{i}/f", t) for i, (_, t) in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(got))] == [license for license, _ in texts]


MIT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2019, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
APACHE = """# Copyright 2020 The Authors. All rights reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() { return 0; }
"""


def test_real_texts_and_headers(spark):
    body = MIT.split("\n\n", 2)[2]
    wrapped = "text of a file.\nThis work is licensed under the GNU General\nPublic License, version 3. And more text."
    files = [
        ("mit/LICENSE", MIT, "MIT"), ("mit/src/a.py", "print()", None), ("body/LICENSE.txt", body, "MIT"), ("spdx/a.c", "// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("spdx/b.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\n" + MIT, "GPL-2.0"), ("bsd3/LICENSE", BSD.format(third=THIRD), "BSD-3-Clause"), ("bsd2/LICENSE", BSD.format(third=""), "BSD-2-Clause"),
        ("bsd3/x.h", "int y;", None), ("ap/x.py", APACHE, "Apache-2.0"), ("gpl/x.c", GPL, "GPL-3.0"), ("wrap/x", wrapped, "GPL-3.0"), ("none/x", "a warranty of nothing, and a licence to write at will", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].own_license for i in range(len(files))] == [x for _, _, x in files]
    assert (got[1].license, got[1].inherited_from) == ("MIT", "mit") and (got[7].license, got[7].inherited_from) == ("BSD-3-Clause", "bsd3")


def test_documents_as_files(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    got = licenses.scan(licenses.as_files(docs)).collect()
    assert len(got) == docs.count()
    noted = {r.doc_id for r in docs.collect() if "Released under the MIT License." in (r.text or "")}
    assert all(r.own_license is not None for r in got if r.doc_id in noted)
