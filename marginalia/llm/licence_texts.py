"""Public licence texts and notices (fixed values; the notices are built from a rule)."""

from __future__ import annotations

from importlib.resources import files

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so"
)

TEXTS: list[tuple[str, str]] = [
    ("MIT", f"MIT License\n{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this "
            f"permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission "
            f"notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n{_MIT_GRANT}.\n{_AS_IS}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear "
            f"in all copies.\n{_ISC_AS_IS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all "
            f"copies.\n{_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_START}{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_START}{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START}{_BSD_NAMES}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_START}{_BSD_NAMES}{_BSD_END}"),
    ("Zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
     "held liable for any damages arising from the use of this software.\n"
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
     "to alter it and redistribute it freely, subject to the following restrictions:\n"
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
     "software. If you use this software in a product, an acknowledgment in the product documentation would be "
     "appreciated but is not required.\n"
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
     "original software.\n"
     "3. This notice may not be removed or altered from any source distribution."),
    ("WTFPL",
     "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n"
     "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0",
     'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n"
     "Unless required by applicable law or agreed to in writing, software distributed under the License is "
     'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
     "the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version.\n"
     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
     "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
     "for more details.\n"
     "You should have received a copy of the GNU General Public License along with this program. If not, see "
     "<https://www.gnu.org/licenses/>."),
    ("MPL-2.0",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

# Licences by the names that notices call them.
NAMES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MIT License", "MIT")),
    ("ISC", ("ISC License",)),
    ("BSD-2-Clause", ("BSD 2-Clause License",)),
    ("BSD-3-Clause", ("BSD 3-Clause License",)),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GPLv3")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3",)),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3",)),
    ("MPL-2.0", ("Mozilla Public License, version 2.0",)),
    ("CC0-1.0", ("CC0 1.0",)),
    ("CC-BY-4.0", ("CC BY 4.0",)),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0",)),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0",)),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0",)),
]
OPENINGS = (
    "Licensed under",
    "This work is licensed under",
    "This software is licensed under",
    "Released under",
    "This project is released under",
    "Distributed under",
)


def notices() -> list[tuple[str, str]]:
    """One-line notices: every opening with every name, with and without an article."""
    return [
        (licence, f"{opening} {article}{name}.")
        for licence, names in NAMES
        for name in names
        for opening in OPENINGS
        for article in ("", "the ")
    ]


END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def full_texts() -> list[tuple[str, str]]:
    """Licences in full, one file each (``licence.txt`` or ``licence--edition.txt``).

    Where a note on how to apply the licence follows its end, also without that, and
    without the line that says where the end is.
    """
    out = []
    for file in sorted(files("marginalia.llm").joinpath("texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            licence, text = file.name.removesuffix(".txt").split("--")[0], file.read_text("utf-8")
            terms, end, _ = text.partition(END_OF_TERMS)
            out += [(licence, t) for t in ([text, terms + end, terms] if end else [text])]
    return out
