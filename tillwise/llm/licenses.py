"""License scans by canonical digest.

A text is brought to a canonical form (lower case, no copyright lines, one
spelling of equivalent words, no punctuation) and its SHA-256 is joined to
the digests of known license texts.  Whole documents are looked up, and so is
every line, for the one-line notices that licenses prescribe.

Defined results for odd input: a null or blank text has the digest of the
empty text and no license; repeated rows are scanned each; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import pkgutil
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: spellings taken as equal -------------------------------------
SPELLINGS = {
    "licence": "license", "sub-license": "sublicense", "sub license": "sublicense", "acknowledgement": "acknowledgment",
    "judgement": "judgment", "authorisation": "authorization", "authorised": "authorized", "organisation":
    "organization", "organise": "organize", "recognise": "recognize", "utilise": "utilize", "favour": "favor",
    "honour": "honor", "labour": "labor", "centre": "center", "catalogue": "catalog", "programme": "program",
    "fulfilment": "fulfillment", "wilful": "willful", "whilst": "while", "per cent": "percent",
    "non-commercial": "noncommercial", "copyright owner": "copyright holder", "https://": "http://",
}
#: Words after "copyright" that make a line part of a license's prose, not a notice with a name.
PROSE = ("act and are as assignment be can claim claims date disclaimer disclaimers doctrine doctrines does exception "
         "exceptions for from grant grants has have header headers holder holders if in info information infringe "
         "infringement interest interests is law laws licence license licensed licenses limitations line lines material "
         "materials may not notice notices of on or owner owners ownership patent permission permissions protected "
         "protection right rights shall statement statements status term terms text that the to trademark treaties "
         "treaty under was were will with work works year").split()
#: The same after "copyright the".
PROSE_THE = ("code document documentation file files library material materials modified original program programs "
             "resulting software source text work works").split()


def _other_word(words) -> str:
    """Pattern of any word but ``words``, without lookahead (DuckDB has none)."""
    def node(heads: list[str], root: bool) -> str:
        ends, nexts = "" in heads, sorted({h[0] for h in heads if h})
        branches = [c + node([h[1:] for h in heads if h[:1] == c], False) for c in nexts]
        if root:
            branches.append(rf"[^\P{{L}}{''.join(nexts)}][^ \t\n]*")
        elif ends:  # a listed word: only more letters make another of it
            branches.append(f"[{''.join(c for c in string.ascii_lowercase if c not in nexts)}][^ \\t\\n]*")
        else:
            branches += [rf"[^{''.join(nexts)} \t\n][^ \t\n]*", ""]
        return f"(?:{'|'.join(branches)})"
    return node(list(words), True)


COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]|by |<|\[)[^\n]*"
    rf"|copyright:?[ \t]+(?:the[ \t]+{_other_word(PROSE_THE)}|{_other_word(PROSE)})(?:[ \t][^\n]*)?)$")
RESERVED_LINE = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"

# --- fixed values: known license texts --------------------------------------------
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
          "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
          "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
          "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
          "substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
          "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
          "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
          "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
          "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n")
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
            "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
            "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_ZERO = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
         "granted.\n")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:\n",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.\n",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.\n",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.\n")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
            "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE.")
#: Whole texts in ``license_texts/``, and the line that ends the terms where an appendix may be left off.
TEXTS = {
    "Apache-2.0": "END OF TERMS AND CONDITIONS", "Artistic-1.0-Perl": None, "BSD-3-Clause": None, "BSL-1.0": None,
    "CC0-1.0": None, "GFDL-1.2": "ADDENDUM: How to use", "GFDL-1.3": "ADDENDUM: How to use",
    "GPL-1.0": "END OF TERMS AND CONDITIONS", "GPL-2.0": "END OF TERMS AND CONDITIONS",
    "GPL-3.0": "END OF TERMS AND CONDITIONS", "LGPL-2.0": "END OF TERMS AND CONDITIONS",
    "LGPL-2.1": "END OF TERMS AND CONDITIONS", "LGPL-3.0": None, "MPL-1.1": None,
    "MPL-2.0": "Exhibit A - Source Code Form License Notice\n", "Unlicense": None,
}
#: Names that notice lines use.
NAMES = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"), "BSL-1.0": ("Boost Software License, Version 1.0",),
    **{f"{k}GPL-{v}.0": (f"GNU {n}General Public License, version {v}", f"GNU {n}General Public License v{v}",
                         f"GNU {n}General Public License v{v}.0", f"GNU {k}GPL v{v}", f"{k}GPLv{v}")
       for k, n, v in (("", "", 1), ("", "", 2), ("", "", 3), ("L", "Library ", 2), ("L", "Lesser ", 3),
                       ("A", "Affero ", 3))},
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1",
                 "GNU LGPL v2.1", "LGPLv2.1"),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"), "Unlicense": ("Unlicense",),
    "Artistic-1.0-Perl": ("Artistic License",),
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {n} {v} International License",
                       f"Creative Commons {n} {v} License")
       for k, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                    ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")},
}
_FRANKLIN = re.compile(r"51 Franklin Street, Fifth Floor,(\s+)Boston, MA(\s+)02110-1301")


def _stored():
    """Each text of ``license_texts``: whole, without its appendix, with the
    address that the foundation had before."""
    for name, end in TEXTS.items():
        text = pkgutil.get_data("tillwise.llm", f"license_texts/{name}.txt").decode("utf-8")
        cuts = [text]
        if end:
            at = text.index(end)
            cuts.append(text[:at + len(end)] if end.startswith("END") else text[:at])
            if end.startswith("END"):
                cuts.append(text[:at])
        for cut in cuts:
            yield name, cut
            older = _FRANKLIN.sub(r"59 Temple Place, Suite 330,\1Boston, MA\g<2>02111-1307", cut)
            if older != cut:
                yield name, older


def _bsd():
    """BSD texts with two and three clauses, with numbers, letters or bullets, with and without title."""
    for name, n, titles in (("BSD-2-Clause", 2, ("BSD 2-Clause License\n", "Simplified BSD License\n")),
                            ("BSD-3-Clause", 3, ("BSD 3-Clause License\n", "New BSD License\n"))):
        for title in ("", *titles):
            for marks in ("123", "abc", "***"):
                yield name, title + _BSD[0] + "".join(f"{m}. {x}" for m, x in zip(marks, _BSD[1:n + 1])) + _BSD_END


def _notices():
    for name, names in NAMES.items():
        yield name, f"SPDX-License-Identifier: {name}"
        if "GPL-" in name or "GFDL-" in name:
            for tail in ("-only", "-or-later", "+"):
                yield name, f"SPDX-License-Identifier: {name}{tail}"
        for n in names:
            for lead in ("Licensed under", "Released under", "Distributed under", "This work is licensed under"):
                for article in ("", "the "):
                    yield name, f"{lead} {article}{n}."
    yield "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"


KNOWN = (
    ("MIT", "MIT License\n" + _GRANT), ("MIT", _GRANT), ("MIT", "The MIT License (MIT)\n" + _GRANT),
    ("ISC", "ISC License\n" + _ISC + _ISC_END), ("ISC", _ISC + _ISC_END),
    ("0BSD", "BSD Zero Clause License\n" + _ZERO + _ISC_END), ("0BSD", _ZERO + _ISC_END),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    *_stored(), *_bsd(), *_notices(),
)
#: Most digests that the line lookup takes as a set and the join broadcasts.
MOST_KNOWN = 100_000


def canonical(text: Column) -> Column:
    plain = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(plain, COPYRIGHT_LINE, ""), RESERVED_LINE, "")
    for other, usual in SPELLINGS.items():
        plain = F.replace(plain, F.lit(other), F.lit(usual))
    return F.btrim(F.regexp_replace(plain, PUNCTUATION, " "), F.lit(" "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``digest, license``: one row per known text; of equal digests the first name."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"{len(known)} license texts, at most {MOST_KNOWN} can be sent to all workers")
    table = spark.createDataFrame(list(known), "license string, text string")
    return table.select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(
        F.min("license").alias("license"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """``doc_id, digest, license, notices`` of every row: the license that the
    whole text is (or null), and those whose notices stand on its lines,
    sorted and joined by commas."""
    table = known_digests(docs.sparkSession, known)
    names = {r.digest: r.license for r in table.collect()}
    empty = F.array().cast("array<string>")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    found = F.filter(F.transform(lines, digest), lambda d: d.isin(*names)) if names else empty
    lookup = F.map_from_arrays(*[F.split(F.lit("\n".join(x)), "\n") for x in zip(*names.items())]) if names else F.lit(
        None).cast("map<string,string>")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), found.alias("_found"))
    # bounded: MOST_KNOWN rows
    return rows.join(F.broadcast(table), "digest", "left").select(
        "doc_id", "digest", "license",
        F.array_join(F.sort_array(F.array_distinct(F.transform("_found", lambda d: F.element_at(lookup, d)))), ",")
        .alias("notices"))
