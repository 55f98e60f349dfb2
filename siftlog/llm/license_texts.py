"""Known licence texts and short licence notices.

Facts to compare with, so they are public texts as they stand.  ``LICENSE_TEXTS`` also holds the forms they are found in:
short ones under other titles or none, long ones without their appendix or with an older address, and SPDX lines.
"""

import re

from siftlog.llm.license_full_texts import FULL_TEXTS

LICENSE_TEXTS: list[tuple[str, str]] = [
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]

_BSD_3 = LICENSE_TEXTS[3][1].replace("BSD 2-Clause", "BSD 3-Clause").replace("\n\nTHIS SOFTWARE", """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE""")
_TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], "ISC": ["The ISC License", "ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License (0BSD)"], "Zlib": ["The zlib License"],
    "BSD-2-Clause": ["The BSD 2-Clause License", "BSD-2-Clause"], "BSD-3-Clause": ["The BSD 3-Clause License", "BSD-3-Clause"],
}


def _retitled(license: str, text: str) -> list[tuple[str, str]]:
    """A text that begins with its title, without it and under other titles."""
    body = text.split("\n\n", 1)[1]
    return [(license, body), *((license, f"{title}\n\n{body}") for title in _TITLES[license])]


def _forms(license: str, text: str) -> list[tuple[str, str]]:
    """A full text, also up to the end of its terms, with its template for a copyright line filled in, and with the address
    the Free Software Foundation had before."""
    forms = [text]
    terms = re.search(r"END OF TERMS AND CONDITIONS", text)
    if terms:
        forms.append(text[:terms.end()])
        forms.append(text[:terms.start()].rstrip())
    if "[name of copyright owner]" in text:  # a filled line is a copyright statement, which is dropped
        forms.append(text.replace("Copyright [yyyy] [name of copyright owner]", ""))
    address = r"51 Franklin St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA"
    forms += [re.sub(address, "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", form) for form in forms if re.search(address, form)]
    return [(license, form) for form in forms]


_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. \
You may obtain a copy of the License at"""
_APACHE_REST = """http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, \
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing \
permissions and limitations under the License."""
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")
# whole headers, their first paragraphs on one line, and the lines of the usual wrapping that name a licence
_HEADERS: list[tuple[str, str]] = [
    ("Apache-2.0", f"{_APACHE}\n\n{_APACHE_REST}"), ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'),
    ("Apache-2.0", "The ASF licenses this file to You under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MPL-2.0", _MPL), ("MPL-2.0", _MPL.replace(" at http", ",\nat http")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_GNU = {"General Public License": {"GPL-1.0": "1", "GPL-2.0": "2", "GPL-3.0": "3"}, "Affero General Public License": {"AGPL-3.0": "3"},
        "Library General Public License": {"LGPL-2.0": "2"}, "Lesser General Public License": {"LGPL-2.1": "2.1", "LGPL-3.0": "3"}}
for _name, _versions in _GNU.items():
    for _id, _version in _versions.items():
        _HEADERS += [(_id, f"This work is licensed under the GNU {_name}, version {_version}."), (_id, f"Licensed under the GNU {_name}, version {_version}.")]
        # punctuation does not count
        _HEADERS += [(_id, f"This {_what} is free software; you can redistribute it and/or modify it under the terms of the GNU {_name} as published by "
                           f"the Free Software Foundation; either version {_version} of the License, or (at your option) any later version.")
                     for _what in ("program", "library", "file")]

# "+" is no letter, so GPL-2.0+ is the line of GPL-2.0
_SPDX = {
    "MIT": [], "ISC": [], "0BSD": [], "Zlib": [], "BSD-2-Clause": [], "BSD-3-Clause": [], "Apache-2.0": [], "MPL-1.1": [], "MPL-2.0": [],
    "Unlicense": [], "BSL-1.0": [], "CC0-1.0": [], "CC-BY-4.0": [], "CC-BY-SA-4.0": [], "CC-BY-NC-4.0": [],
    **{gnu: ["-only", "-or-later"] for versions in _GNU.values() for gnu in versions},
}
LICENSE_TEXTS += [
    *(form for license, text in LICENSE_TEXTS[:5] for form in _retitled(license, text)),
    ("BSD-3-Clause", _BSD_3), *_retitled("BSD-3-Clause", _BSD_3),
    *(form for license, text in FULL_TEXTS for form in _forms(license, text)), *_HEADERS,
    *((license, f"SPDX-License-Identifier: {license}{end}") for license, ends in _SPDX.items() for end in ["", *ends]),
]

# Spellings that count as equal; applied to lower-case words with single spaces between them.
EQUIVALENT_SPELLINGS: list[tuple[str, str]] = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorise", "authorize"), ("behaviour", "behavior"), ("catalogue", "catalog"),
    ("centre", "center"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("merchantibility", "merchantability"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("optimisation", "optimization"), ("organisation", "organization"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"),
    ("sub license", "sublicense"), ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"),
]
