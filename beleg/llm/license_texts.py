"""Texts of common license notices, as templates of the license scan."""

# Name -> text. Placeholders such as years and holders are left out; words are compared without case and punctuation.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MIT-notice": "Released under the MIT License.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License."),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}

_FREE = "you can redistribute it and/or modify it under the terms of the GNU {family} as published by the Free Software Foundation"
_LATER = "; either version {version} of the License, or (at your option) any later version."
_HOPE = (
    " This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {family} for more details.")
_GNU = {"GPL": ("General Public License", "program"), "LGPL": ("Lesser General Public License", "library"), "AGPL": ("Affero General Public License", "program")}

for _id, _version in (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
    _family, _work = _GNU[_id]
    _name = f"{_id}-{_version if '.' in _version else _version + '.0'}"
    _start = f"This {_work} is free software; {_FREE.format(family=_family)}"
    _first, _hope = _start + _LATER.format(version=_version), _HOPE.format(work=_work, family=_family)
    if _name != "GPL-2.0":
        TEMPLATES[f"{_name}-or-later-first"] = _first
    if _name != "GPL-3.0":
        TEMPLATES[f"{_name}-or-later-long"] = _first + _hope
    TEMPLATES[f"{_name}-only"] = f"{_start}; version {_version} of the License."
    TEMPLATES[f"{_name}-only-terms"] = _start.replace("terms of", f"terms of version {_version} of") + "."
    if _name != "GPL-3.0":
        TEMPLATES[f"{_name}-notice"] = f"Licensed under the GNU {_family}, version {_version}."
    TEMPLATES[f"{_name}-or-later-notice"] = f"Licensed under the GNU {_family}, version {_version} or later."

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _id, _long in _CC.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        _name = f"CC-{_id}-{_version}"
        for _text in (f"This work is licensed under a Creative Commons {_long} {_version} {_port} License.", f"Licensed under CC {_id} {_version}."):
            if _text not in TEMPLATES.values():
                TEMPLATES[_name if _name not in TEMPLATES else f"{_name}-long" if _long in _text else f"{_name}-short"] = _text

TEMPLATES["BSD-2-Clause-notice"] = "Licensed under the BSD 2-Clause License."
TEMPLATES["BSD-3-Clause-notice"] = "Licensed under the BSD 3-Clause License."
TEMPLATES["ISC-notice"] = "Licensed under the ISC License."
TEMPLATES["MPL-2.0-notice"] = "Licensed under the Mozilla Public License, version 2.0."
TEMPLATES["EPL-2.0-notice"] = "Licensed under the Eclipse Public License, version 2.0."
TEMPLATES["BSL-1.0"] = "Distributed under the Boost Software License, Version 1.0."
TEMPLATES["CC0-1.0-notice"] = "Licensed under CC0 1.0 Universal."
TEMPLATES["Zlib"] = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.")

for _id in (
        "MIT BSD-2-Clause BSD-3-Clause ISC Apache-2.0 MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 GPL-2.0-only GPL-2.0-or-later "
        "GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later").split():
    TEMPLATES[f"{_id}-spdx"] = f"SPDX-License-Identifier: {_id}"
