"""Licence scan by canonical digests, in DataFrame functions only."""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import LOWER, UPPER, ascii_lower

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Names that SPDX lines may hold. Fixed values.
SPDX = (
    *("MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Zlib", "Apache-1.1", "Apache-2.0", "MPL-1.1", "MPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "WTFPL", "PostgreSQL", "NCSA", "OFL-1.1", "PSF-2.0"),
    *("EPL-1.0", "EPL-2.0", "EUPL-1.2", "CDDL-1.0", "CDDL-1.1", "Artistic-1.0", "Artistic-2.0", "MS-PL", "Apache-2.0 WITH LLVM-exception", "MIT OR Apache-2.0", "Apache-2.0 OR MIT"),
    *(f"{name}{end}" for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3") for end in ("", "-only", "-or-later")),
    *(f"CC-{kind}-{version}" for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("3.0", "4.0")),
)
#: The notices of the GNU licences: name, title, version, what is licensed.
_GNU = (("GPL-2.0", "", "2", "program"), ("GPL-3.0", "", "3", "program"), ("LGPL-2.1", "Lesser ", "2.1", "library"), ("LGPL-3.0", "Lesser ", "3", "library"), ("LGPL-3.0", "Lesser ", "3", "program"), ("AGPL-3.0", "Affero ", "3", "program"))
_GNU_ENDS = (
    "You should have received a copy of the GNU {title}General Public License along with this {what}. If not, see http://www.gnu.org/licenses/.",
    "You should have received a copy of the GNU {title}General Public License along with this {what}; if not, see http://www.gnu.org/licenses/.",
    *("You should have received a copy of the GNU {title}General Public License along with this {what}; if not, write to the Free Software Foundation, Inc., " + place for place in ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")),
)
_GNU_NOTICES = tuple(
    (name + kind, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {title}General Public License as published by the Free Software Foundation; {version}\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title}General Public License for more details.\n\n" + end.format(title=title, what=what))
    for name, title, number, what in _GNU
    for kind, version in (("-or-later", f"either version {number} of the License, or (at your option) any later version."), ("-only", f"version {number} of the License."))
    for end in _GNU_ENDS
)

#: Licence texts and notices. The wording is that of the licences.
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY),
    ("Zlib", "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Apache License notice\n\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    *((f"CC-{kind}-4.0", f"{start} CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for start in ("Licensed under", "This work is licensed under", "Released under")),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
    *_GNU_NOTICES,
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
)

#: Words that after "copyright", and after "copyright the", go on with a clause and not with a name. Fixed values.
_CLAUSE = "act acts all an and any applies are as at be below but can claim claims date disclaimer disclaimers doctrines does exists for from has have header holder holder's holders if in including infringement infringements information interest interests is it its law laws licence licences license licensed licenses like line lines material may message must not notice notices of office on only or owner owner's owners ownership permission permissions policy protected protection resulting right rights rules shall similar statement statements status such term terms that then this to treaties treaty under unless was which will with within without work works".split()
_THE_CLAUSE = "above code copy copyrighted covered document documentation file files following holder holders law laws library licence license licensed licensor material materials notice notices original owner owners package product program result rights same software source text work works".split()


def _other_than(words: list[str]) -> str:
    """Pattern of a word that is none of ``words``, if its end is asked for behind it: not every engine has look-ahead."""
    first = sorted({w[0] for w in words if w})
    ends = r" \t\r\n.,:;()/"
    turns = [c + _other_than([w[1:] for w in words if w[:1] == c]) for c in first]
    return "(" + "|".join([*turns, f"[^{ends}{''.join(first)}][^{ends}]*", *([] if "" in words else [""])]) + ")"


#: Lines that carry no terms: who holds the copyright, rights reserved, the licence's name by itself. After lower-casing.
DROPPED = (
    r"(^|\n)[ \t*#/;>-]*copyright[ \t:,]*(\(c\)|©|[0-9]{4}|<|\[)[^\n]*",
    r"(^|\n)[ \t*#/;>-]*portions copyright[ \t:,]*(\(c\)|©|[0-9]{4}|<|\[)[^\n]*",
    r"(^|\n)[ \t*#/;>-]*(portions )?copyright[ \t:,]+(the[ \t]+" + _other_than([*_THE_CLAUSE, ""]) + "|" + _other_than([*_CLAUSE, "the", ""]) + r")([ \t\r.,:;()/][^\n]{0,80})?(\n|\z)",
    r"(^|\n)[ \t*#/;>-]*(\(c\)|©)[^\n]*",
    r"(^|\n)[ \t*#/;>-]*all rights reserved[ \t.]*",
    r"(^|\n)[ \t*#/;>-]*(the )?(mit|expat|isc|zlib|apache|bsd [0-9a-z-]+( clause)?) licen[cs]e( notice)?( \([a-z0-9. -]+\))?[ \t\r:]*(\n|\z)",
)
#: Spellings that count as the same. Fixed values.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("copyright owner", "copyright holder"), ("https://", "http://"))
#: What is neither a letter, a digit nor beyond ASCII, as one space. The notation that both regular expression engines read.
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case A-Z, without copyright lines, one spelling of each word, and one space for all punctuation."""
    made = F.replace(ascii_lower(text), F.lit("\n"), F.lit("\n\n"))  # neighbours don't share a line feed
    for pattern in DROPPED:
        made = F.regexp_replace(made, pattern, "\n")
    for other, usual in SPELLINGS:
        made = F.replace(made, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(made, BETWEEN, " "))


def canonical_text(text: str) -> str:
    """The same of one Python string, for the table of known digests."""
    made = text.translate(str.maketrans(UPPER, LOWER)).replace("\n", "\n\n")
    for pattern in DROPPED:
        made = re.sub(pattern.replace(r"\z", r"\Z"), "\n", made)
    for other, usual in SPELLINGS:
        made = made.replace(other, usual)
    return re.sub(r"[^a-z0-9\u0080-\U0010ffff]+", " ", made).strip(" ")


#: Digests of whole licences whose texts are too long to stand here, by the canonical form above: with and without what follows
#: their terms, and in the wordings that are in use. Fixed values.
WHOLE = (
    ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "GPL-2.0"),
    ("e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "GPL-2.0"),
    ("aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75", "GPL-2.0"),
    ("c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c", "GPL-2.0"),
    ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "GPL-3.0"),
    ("ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "GPL-3.0"),
    ("0d3bfcceda6470dcd13089cae938e4e0251be32d7ab34ca76aea6195a56230bf", "GPL-3.0"),
    ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "LGPL-2.0"),
    ("504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "LGPL-2.0"),
    ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "LGPL-2.1"),
    ("48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "LGPL-2.1"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0"),
    ("905cb44fb0178cb947d66c0ea4aecab0b8eb3502ef89c93d6c1560d9cd8a7b91", "Apache-2.0"),
    ("2295e316b6e525a824b867463925b9336c159a244448c57e561e3a013db1ae5a", "Apache-2.0"),
    ("6dd8d52e606b65e8a7d2366f831c26b9b943ac031fec911d37be5b683c8fe83d", "Apache-2.0"),
    ("0195c70a48d95f44ab26a54d483056b4c2354355f4284aff675c6ce880a19207", "Apache-2.0"),
    ("128a92e969ac7c519436f141037191f811e921fbd64b2069386b33ad549461b8", "Apache-2.0"),
    ("e77388e5cf29a75d5c88ffbafec88f732e30ccaa9f1df51549770be7dbebf6be", "Apache-2.0"),
    ("9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56", "MPL-2.0"),
    ("f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", "MPL-1.1"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
    ("03d8a3b9c6db6790c3520a25812373d89c7f2a005ef01b18a0abcd015657a456", "CC-BY-SA-4.0"),
    ("7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd", "Unlicense"),
    ("4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6", "BSL-1.0"),
    ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", "Artistic-1.0"),
    ("15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b", "GFDL-1.2"),
    ("2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d", "GFDL-1.3"),
)


@functools.lru_cache
def known_digests() -> tuple[tuple[str, str], ...]:
    """(digest, licence) of the known texts."""
    found = {hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in KNOWN} | dict(WHOLE)
    return tuple(sorted(found.items()))


#: What every known notice of one line holds, so that other lines need no digest.
MARK = "licen|released under"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 of the canonical text), license, and notices, of every row.

    ``license`` is that of the known text whose canonical form equals that of the entire text, else null;
    ``notices`` has the licences of the text's lines that by themselves are a known notice, sorted, each once,
    comma-joined (empty: none). Null counts as an empty text, whose digest is that of no bytes and is no
    licence. Repeated rows, null ids and other columns (not read) make no difference; an empty table gives no
    rows. ``known(digest, license)`` replaces the built-in table for the join; it is broadcast only if Spark
    knows it to be small.
    """
    table = known_digests()
    text = F.coalesce(F.col(text_col), F.lit(""))
    lookup = F.create_map(*[F.lit(x) for pair in table for x in pair])
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(ascii_lower(x), F.lit(MARK)))
    names = F.transform(lines, lambda x: F.element_at(lookup, F.sha2(canonical_line(x).cast("binary"), 256)))
    notices = F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), ",")
    base = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(text).cast("binary"), 256).alias("digest"), notices.alias("notices"))
    if known is None:
        known = F.broadcast(docs.sparkSession.range(1).select(F.explode(lookup).alias("digest", "license")))  # some 200 rows
    else:
        known = known.groupBy("digest").agg(F.min("license").alias("license"))
    return base.join(known.filter(F.col("digest").isNotNull()), "digest", "left").select("doc_id", "digest", "license", "notices")


def canonical_line(line: Column) -> Column:
    """As ``canonical``, of one line: a licence's name by itself is kept, it may be the notice."""
    made = ascii_lower(line)
    for other, usual in SPELLINGS:
        made = F.replace(made, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(made, BETWEEN, " "))


def sql_canonical(text: str, whole: bool = True) -> str:
    """The canonical form as a DuckDB expression over the expression ``text``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    made = f"translate({text}, {quote(UPPER)}, {quote(LOWER)})"
    made = f"replace({made}, chr(10), chr(10) || chr(10))" if whole else made
    for pattern in DROPPED if whole else ():
        made = f"regexp_replace({made}, {quote(pattern)}, chr(10), 'g')"
    for other, usual in SPELLINGS:
        made = f"replace({made}, {quote(other)}, {quote(usual)})"
    return f"trim(regexp_replace({made}, {quote(BETWEEN)}, ' ', 'g'), ' ')"


def oracle_sql() -> str:
    known = ", ".join(f"('{digest}', '{name}')" for digest, name in known_digests())
    return f"""
WITH known(digest, license) AS (VALUES {known}),
base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base),
notices AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON digest = sha256({sql_canonical("line", False)})
  GROUP BY r
), whole AS (SELECT r, doc_id, sha256({sql_canonical("text")}) AS digest FROM base)
SELECT doc_id, whole.digest AS digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON whole.digest = known.digest LEFT JOIN notices USING (r)
"""


#: Whole licences and notices whose look-up ``texts`` shows.
SHOWN = 24


def texts() -> list[tuple[int, str]]:
    """(id, text): known texts as they are, in capitals under a copyright line, and with a sentence that makes them other texts."""
    forms = (lambda t: t, lambda t: "Copyright (c) 2020 Some Holder. All rights reserved.\n\n" + t.upper(), lambda t: t + "\n\nThe software shall be used for good.")
    return [(3 * i + j, form(text)) for i, (_, text) in enumerate(KNOWN[:SHOWN]) for j, form in enumerate(forms)]


def texts_sql() -> str:
    """``oracle_sql`` over ``texts``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(t)})" for i, t in texts())
    return "WITH documents(doc_id, text) AS (SELECT CAST(i AS BIGINT), t FROM (VALUES " + rows + ") AS v(i, t))," + oracle_sql().lstrip().removeprefix("WITH")
