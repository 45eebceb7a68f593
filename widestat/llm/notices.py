"""License notices that the license scan looks for.

Each is a label, the notice's words and the key phrases that must stand in it.
Short forms are single sentences or names; long forms are the notices as files
carry them, so their score tells how much of a notice is there.
"""

from __future__ import annotations

_GPL = ("you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        "Foundation, either version {version} of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
_AS_IS = ("IN NO EVENT SHALL THE COPYRIGHT {holder} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
          "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
          "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
          "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
          "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

# (label, notice, mandatory key phrases): fixed texts of common notices.
SHORT_FORMS = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction",
     ("free of charge", "to deal in the software without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
     ("gnu general public license", "version 3")),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2",
     ("gnu general public license", "version 2")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation",
     ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ("gnu lesser general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met",
     ("source and binary forms", "following conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("released into the public domain",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
)

LONG_FORMS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
     ("to deal in the software without restriction", "substantial portions of the software")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License.",
     ("apache license version 2 0", "in compliance with the license")),
    ("gpl-3.0", "This program is free software: " + _GPL.format(name="General Public License", version="3"),
     ("gnu general public license", "either version 3 of the license")),
    ("gpl-2.0", "This program is free software; " + _GPL.format(name="General Public License", version="2"),
     ("gnu general public license", "either version 2 of the license")),
    ("lgpl-3.0", "This program is free software: " + _GPL.format(name="Lesser General Public License", version="3"),
     ("gnu lesser general public license", "either version 3 of the license")),
    ("lgpl-2.1", "This library is free software; " + _GPL.format(name="Lesser General Public License", version="2.1"),
     ("gnu lesser general public license", "either version 2 1 of the license")),
    ("agpl-3.0", "This program is free software: " + _GPL.format(name="Affero General Public License", version="3"),
     ("gnu affero general public license", "either version 3 of the license")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
            "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
            "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
            "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            + _AS_IS.format(holder="HOLDER OR CONTRIBUTORS"),
     ("source and binary forms", "following disclaimer")),
    ("bsd-3-clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission.",
     ("endorse or promote products derived from this software",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
            "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
            "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
     ("with or without fee is hereby granted", "the author disclaims all warranties")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
     ("mozilla public license v 2 0", "a copy of the mpl")),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means.",
     ("released into the public domain", "commercial or non commercial")),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
             "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
             "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
             "not claim that you wrote the original software.",
     ("the origin of this software must not be misrepresented",)),
    ("cc0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and "
                "related or neighboring rights to this work.",
     ("waived all copyright and related or neighboring rights",)),
    *((label, f"This work is licensed under a Creative Commons {kind} 4.0 International License.", (f"creative commons {words} 4 0",))
      for label, kind, words in (
          ("cc-by-4.0", "Attribution", "attribution"),
          ("cc-by-sa-4.0", "Attribution-ShareAlike", "attribution sharealike"),
          ("cc-by-nd-4.0", "Attribution-NoDerivatives", "attribution noderivatives"),
          ("cc-by-nc-4.0", "Attribution-NonCommercial", "attribution noncommercial"),
          ("cc-by-nc-sa-4.0", "Attribution-NonCommercial-ShareAlike", "attribution noncommercial sharealike"))),
)

NOTICES = SHORT_FORMS + LONG_FORMS
