"""Known licence texts and one-line notices, by SPDX-style identifier. Long texts are files of ``licence_files``."""

from pathlib import Path

# Public licence texts.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Lines that stand before the texts of a licence.
_TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Revised BSD License", "Modified BSD License", "BSD License", "BSD-3-Clause"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def _bulleted(body: str) -> str:
    """The conditions with bullets instead of numbers."""
    return body.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")


def _of_regents(body: str) -> str:
    """The text with its first owner named."""
    body = body.replace("Neither the name of the copyright holder", "Neither the name of the University")
    return body.replace("THE COPYRIGHT HOLDERS AND", "THE REGENTS AND").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")


def _stored(name: str) -> list[str]:
    """The texts of a file: whole, and without what stands behind the terms; links with and without encryption."""
    text = (Path(__file__).with_name("licence_files") / f"{name}.txt").read_text(encoding="utf-8")
    end = "END OF TERMS AND CONDITIONS"
    head, found, _ = text.partition(end)
    texts = [text, *([head + found, head] if found else [])]
    texts += [t.replace("https://www.gnu.org/licenses/why-not", "http://www.gnu.org/philosophy/why-not") for t in texts]
    texts += [t.removeprefix("Creative Commons Legal Code") for t in texts]
    return list(dict.fromkeys(x for t in texts for x in (t, t.replace("https://", "http://"), t.replace("https://", "http://").replace("http://", "https://"))))


_ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies.\n\n"
_BSD_2, _BSD_3 = _BSD_HEAD + _BSD_TAIL, _BSD_HEAD + _BSD_THIRD + _BSD_TAIL

_WHOLE: list[tuple[str, str]] = [
    ("MIT", _MIT_GRANT),
    ("ISC", _ISC_GRANT + _ISC_CONDITION + _ISC_WARRANTY),
    ("ISC", _ISC_GRANT.replace("and/or", "and") + _ISC_CONDITION + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    *(("BSD-2-Clause", form(body)) for body in (_BSD_2, _of_regents(_BSD_2)) for form in (str, _bulleted)),
    *(("BSD-3-Clause", form(body)) for body in (_BSD_3, _of_regents(_BSD_3), _BSD_3.replace("name of the copyright", "name of copyright")) for form in (str, _bulleted)),
    *((name, text) for name in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense") for text in _stored(name)),
]

TEXTS: list[tuple[str, str]] = [
    *((name, head + body) for name, body in _WHOLE for head in ("", *(f"{title}\n\n" for title in _TITLES.get(name, ())))),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("proprietary", "All rights reserved."),
]

# Equivalent spellings, whole words in canonical form; single words, since a text may be wrapped between two.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("noninfringement", "non infringement"),
    ("noncommercial", "non commercial"),
    ("percent", "per cent"),
    ("owner", "holder"),
]

# Words that follow ``copyright`` in prose; those of the known texts are added to them.
PROSE: tuple[str, ...] = (
    "and", "claim", "claims", "holder", "holders", "in", "infringement", "interest", "interests", "is", "law", "laws", "license", "licenses",
    "licence", "licences", "notice", "notices", "of", "on", "or", "owner", "owners", "ownership", "protection", "right", "rights", "statement",
    "statements", "to", "treaty",
)
