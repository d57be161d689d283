"""Known licences: fixed values, public texts and notices.

Copyright lines are left out: the canonical form drops them anyway.
"""

#: Equivalent spellings in canonical text, as patterns over lower-case words; fixed values.
EQUIVALENT_SPELLINGS = (
    (r"licenc(e|es|ed|ing|ee|ees|or|ors)\b", "licens$1"),
    (r"is(ation|ations|e|ed|es|er|ers|ing|able)\b", "iz$1"),
    (r"\b(fav|col|behavi|hon|endeav)our", "$1or"),
    (r"(dg)ement", "$1ment"),
    (r"ll(ed|ing)\b", "l$1"),
    (r"\b(sub|non|re|per) (licens\w*|commercial|infringement|infringing|distribut\w*|cent)\b", "$1$2"),
    (r"\bcopyright (owner|owners|holders)\b", "copyright holder"),
    (r"\bhttps\b", "http"),
    (r"\bwhilst\b", "while"),
)

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n'
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)

_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)

#: (license_id, text)
KNOWN_LICENSES = (
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_GRANT + "1. " + _BSD_SOURCE + "\n\n2. " + _BSD_BINARY + "\n\n" + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_GRANT + "1. " + _BSD_SOURCE + "\n\n2. " + _BSD_BINARY + "\n\n3. " + _BSD_NAME + "\n\n" + _BSD_DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

#: (license_id, digest of the canonical form) of long licences: whole, without what follows the terms, and with former
#: addresses of the Free Software Foundation. Digests hold for licenses.digest as it is; a change of the canonical form changes them.
KNOWN_DIGESTS = (
    ("Apache-2.0", "7c95d686b2aa89af6d7f6c0b895782295ddddaaf11fce049abc879f245d27b9c"),
    ("Apache-2.0", "7bd3cdfac0e1afc389079922fa8eaf7416c1a6765e93c3835050acae8873960e"),
    ("Apache-2.0", "2c039ebf7cb245d20fe7ca281f9428088f49c6d9fc2932d7ef774aa899e46e6d"),
    ("Apache-2.0", "a718715d4c9409abe18ec05aa425b591b35c9cf31961b4a0b8f15efdd33fa1db"),
    ("Apache-2.0", "3c57e739f91899a06f6c655ad01e3f44b41e26a6efb9ff22d8cbfd9594932de9"),
    ("Apache-2.0", "10ca09f968996b69dce4cb77f5b79b6cbecc8467ee9d11675bbb67a396176250"),
    ("Artistic-1.0-Perl", "470bee3a1ecd71bc9440d5a274ab7ae1764e988cc8c1d53a98cdc28ccd125c04"),
    ("CC0-1.0", "b096badc0168abbd7a6496f3097d3b3e33b5d3d54dbc0990a1eb8341c549c075"),
    ("GFDL-1.2-only", "5f2c8c7d7e84245eea44c1f9a6f4924edea8c866224333c1b374de8948929470"),
    ("GFDL-1.2-only", "116948768a5795e26c7570fc18ca7f11282812416b66649601b9a6bb60b2461f"),
    ("GFDL-1.3-only", "5497a633e121ba304ab6c3df9159242e0d8204ad88499eda6adb4b197a83fb13"),
    ("GPL-1.0-only", "e2d990cc9e9342197cee706c8446f72746a4f7e50b1d847f761c2982573d1ee8"),
    ("GPL-1.0-only", "9d0d6007274aaa6f9742320c34ee5770038a56a59f73d4c2085dfae6d890fc6a"),
    ("GPL-1.0-only", "6b9dad1e7425b0cf379ae8c4066ab2578356301ed5afa88f9cf240972fe36600"),
    ("GPL-1.0-only", "6bea5529fc34912ff6ae60e2179fcff1d59300e692e489aee90221f959bcbadf"),
    ("GPL-1.0-only", "a453d2e678bcdfe26bf493a8ab3cfad6f61f9e03fb72a8349cfa5933ac7371bc"),
    ("GPL-1.0-only", "d68687f3fe77c262d7e92e9773c24ae3806358595bfa3edc01375087715e5bca"),
    ("GPL-2.0-only", "70b22f9f88d716479de6874fb0fb6bbd350edb8f58fe005664ec96390cec3840"),
    ("GPL-2.0-only", "685dc7e69ec0a2a1ed7aa4405afd97ebee0e2b7ad384cdcdca8489c4e230f99f"),
    ("GPL-2.0-only", "a48ff34f812d07b1f4a01547664c89fa574a4ae5ed26d64ae3b6bec4e696102c"),
    ("GPL-2.0-only", "1781bd65df6e526429decd03065e85bd35991c23034c96315fb7d732affdbcac"),
    ("GPL-2.0-only", "5ffef697c68a2ff50f6fce483c2380c49c276fb4de302b3f5abe4d63c27feacf"),
    ("GPL-3.0-only", "ccde37e65850c0fabd60b8d8e4063e33982736ac72e7b167d65a146002fe3e67"),
    ("GPL-3.0-only", "47c09e2c5285894989706a6c2b6d87d4b236bec66c58ab59ed3a4383781289fc"),
    ("GPL-3.0-only", "7b2cb0edd6557f7654babb211d50d6eaad9745da67b756b2a98a48f7891c1ba7"),
    ("LGPL-2.0-only", "fc9af60ce3359c4f931707a4b42a782ad9ef90fe0b6d4cf1129e0b38c64f537f"),
    ("LGPL-2.0-only", "140a2ffddc39154cb54f7715c65133b593d07bd2914899db3c7b27c2f47bab0f"),
    ("LGPL-2.0-only", "ad200520a30492507e3904b4f043c64cf42e09da68463dbd7b3e55e1b7e9221d"),
    ("LGPL-2.0-only", "dedcc68ed9f36bcbb9b8aebaf719681fa906d8d6307e31d3e43ed2f59feeb384"),
    ("LGPL-2.0-only", "666588bd3f71d2f9fbfeb64d25760327d301af478ea51f2ddb822cde9aa51f71"),
    ("LGPL-2.0-only", "be8758b290033d35585252768373fdef6ed3fe97fd7a32ae2f7d34944455d291"),
    ("LGPL-2.0-only", "511a9e5b80fdc485dafd84a7257f8da9dffd6d68783d02b1c43d44fc2a4fe017"),
    ("LGPL-2.0-only", "d5f1ab10cb63a4c6209e6dc19362eef5ba6ed5297c8f6ed0db53075e3e5e6547"),
    ("LGPL-2.0-only", "ba860b84fa087caf1e7ee952fa224cde13019f83cb56b82503ea625e18c97a2d"),
    ("LGPL-2.1-only", "8c5f7ebe8a9433f89ab8ac400772c92bce4fba1024091c6d8704ec0d85bfb050"),
    ("LGPL-2.1-only", "3d88aa95dce35cff7223fb35d3652cce10ea66613321ab4efb4f09df07be270d"),
    ("LGPL-2.1-only", "91e5259fd874244633d2323b1aa1737b8901bf7f80432c38ad3194867ecd452f"),
    ("LGPL-2.1-only", "b5ddb28878b2fb6682352b972e842f5410535a91cdfdac7f3be7fe1f1fc498a0"),
    ("LGPL-2.1-only", "b7d652de0eb87fc3aeca112d945ee6849f9848394ffb3bd8aa3fa1d4710e8bef"),
    ("LGPL-2.1-only", "ee3a3ae1af1ef7a2b216d31eebff4fd169c6886a15b0bc34ad26e5e47c5567d9"),
    ("LGPL-2.1-only", "de8fdb69d1b17f52f3b96cd67e595fbaf8e74478b0abb32afdacaa21ed4f0327"),
    ("LGPL-2.1-only", "07331b82d300465eaffbe1c3bf7aeebb1987e8a48f628e8b51e0d085f7de4a5a"),
    ("LGPL-2.1-only", "0d1e4b402dff3bd3d6b83ae27aae52a384afd98f574d8e0d64efd040978af5bd"),
    ("LGPL-3.0-only", "adf26d04d4dbea92b61c8e866955b0633d43359549a4b09878de8a35410bd5d4"),
    ("MPL-1.1", "000d1a97101ae4c9a3ed4a7398f88f472a771a59532b0ba51e17fc2450811c3f"),
    ("MPL-2.0", "6ba0f283338485e3fec23c718519157ccf498076129a55ae1b3d203d146b6e0d"),
    ("MPL-2.0", "8ca21dded4f6ae17c92d47d0162dce793b455764db2a6ec6d93e9ea160f48a7a"),
    ("Unlicense", "cfef529ab70feb0fe35c11833a3c63a753dfa2dce83b694fec3e2023fb07eae6"),
)

_NAMES = (
    ("MIT", ("MIT", "MIT License")),
    ("ISC", ("ISC", "ISC License")),
    ("BSD-2-Clause", ("BSD 2-Clause", "BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause", "BSD 3-Clause License", "New BSD License")),
    ("Apache-2.0", ("Apache 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache License, Version 2.0")),
    ("MPL-2.0", ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0")),
    ("GPL-2.0-only", ("GPLv2", "GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2.0")),
    ("GPL-3.0-only", ("GPLv3", "GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3.0")),
    ("LGPL-2.1-only", ("LGPLv2.1", "LGPL-2.1", "GNU Lesser General Public License, version 2.1")),
    ("LGPL-3.0-only", ("LGPLv3", "LGPL-3.0", "GNU Lesser General Public License, version 3")),
    ("AGPL-3.0-only", ("AGPLv3", "AGPL-3.0", "GNU Affero General Public License, version 3")),
    ("EPL-2.0", ("EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0")),
    ("BSL-1.0", ("Boost Software License 1.0", "Boost Software License, Version 1.0")),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
)
_FORMS = ("Released under", "Licensed under", "Distributed under", "This project is licensed under", "This work is licensed under", "This software is licensed under", "This file is licensed under")

#: (license_id, text) of usual notices of a line.
KNOWN_NOTICES = tuple((i, f"{form} {article}{name}.") for i, names in _NAMES for name in names for form in _FORMS for article in ("", "the ", "a ")) + tuple(
    (i, f"SPDX-License-Identifier: {spdx}") for i in dict.fromkeys((*(i for i, _ in KNOWN_DIGESTS), *(i for i, _ in KNOWN_LICENSES), *(i for i, _ in _NAMES))) for spdx in dict.fromkeys((i, i.removesuffix("-only")))
)
